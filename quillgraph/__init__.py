"""Document-graph analytics expressed as Spark DataFrame pipelines.

Sub-packages: ``sources`` (tables and file formats), ``functions`` (column
expressions), ``operators`` (relational, graph, vector and chat operators),
``plans`` (the query catalogue with its SQL), ``streaming`` (Structured
Streaming jobs) and ``llm`` (training-data operators, optional: nothing
outside that folder imports it).
"""
