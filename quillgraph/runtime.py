"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, name: str = "quillgraph") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir`` and must do so. Only on a
    single machine where that setting and the context's own folder are both
    unset (tests) is a temporary folder used.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """A checkpoint for loops: it also forgets the plan's estimates.

    A plain checkpoint keeps the estimated size, which every join multiplies;
    after some rounds the number has so many digits that planning never ends.
    """
    spark, done = df.sparkSession, cut(df)
    jdf = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(jdf, spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of its own below the shared one, for tables that a job writes on its way."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
