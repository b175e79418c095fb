"""Sinks: per-document dumps, keyed upserts into folders, partition overwrites and append-only logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.entities import upsert


def per_document(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per document, written anew."""
    df.write.mode("overwrite").partitionBy("docName").format(fmt).save(path)


def json_documents(df: DataFrame, path: str, by: str = "docName") -> None:
    """One JSON array per document, each in a folder of its own."""
    rows = df.groupBy(by).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.withColumn("part", F.sha2(F.col(by), 256)).select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def markdown_of(pages: DataFrame) -> DataFrame:
    """``docName, markdown``: pages in order, joined by a rule."""
    g = pages.groupBy("docName").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("p"))
    return g.select("docName", F.array_join(F.transform("p", lambda x: x["markdown"]), "\n\n---\n\n").alias("markdown"))


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, fresh, old


def recover(spark: SparkSession, path: str) -> bool:
    """Brings a table back whose replacement was stopped halfway; tells whether there is a table."""
    fs, target, _, old = _paths(spark, path)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    return fs.exists(target)


def merge_into(df: DataFrame, path: str, keys: list[str], prefer_new: bool = True, partition: str | None = None) -> None:
    """Keyed upsert into a parquet folder. Running it again with the same rows changes nothing.

    The new version is complete beside the old one before it takes its place; a
    run that was stopped between the two renames is recovered by the next.
    With ``partition`` (a column that equal keys share) the table is partitioned
    by it and only the partitions of the new rows are read and replaced.
    """
    spark = df.sparkSession
    fs, target, fresh, old = _paths(spark, path)
    there = recover(spark, path)
    if there:
        known = spark.read.schema(df.schema).parquet(path) if partition else spark.read.parquet(path)
        if partition:
            known = known.join(df.select(partition).distinct(), partition, "left_semi").select(df.columns)
        df = upsert(known, df, keys, prefer_new)
    if partition and there:
        df.write.mode("overwrite").parquet(path + ".new")
        done = spark.read.parquet(path + ".new")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        fs.delete(fresh, True)
        return
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path + ".new")
    fs.delete(old, True)
    if there:
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def latest(df: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``version``, ties settled by the rows' hash; columns of map type are not allowed."""
    order = F.struct(*([version] if version else []), F.xxhash64(*df.columns))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def clear(spark: SparkSession, path: str, keep: str | None = None) -> None:
    """Empties a table, but for the rows that the condition ``keep`` holds for."""
    fs, target, fresh, old = _paths(spark, path)
    if not recover(spark, path):
        return
    t = spark.read.parquet(path)
    t.where(keep or "false").write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def save_upload(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    """Writes an uploaded file under the last part of its name, whatever folders that names; returns where."""
    plain = re.sub(r"[^\w.\-]+", "_", re.split(r"[\\/]", name)[-1]).lstrip(".") or "upload"
    path = f"{folder.rstrip('/')}/{plain}"
    fs, target, _, _ = _paths(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replaces only the partitions that the rows belong to (an edge type, a corpus)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def evaluation_report(rows: DataFrame, path: str, version: str = "1", **config: str) -> None:
    """A version of an evaluation: its settings as one JSON object and its rows as JSON lines, both below ``path/v<version>``."""
    spark = rows.sparkSession
    pairs = [F.lit(x) for kv in sorted(config.items()) for x in kv]
    settings = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    spark.range(1).select(F.lit(version).alias("version"), settings.alias("config")).coalesce(1).write.mode("overwrite").json(f"{path}/v{version}/config")
    rows.write.mode("overwrite").json(f"{path}/v{version}/rows")


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "exists", "fail")])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that a uniqueness constraint would refuse."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
