"""Session helpers: a tuned session for local runs, and lineage cuts that survive executor loss."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_session(cores: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster pass your own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without one gets a folder of its own: elsewhere it would be on one machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="docflow-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and go on from the files.

    The files are compressed columns, a fraction of a checkpoint's rows on disk; what they cannot name or hold (columns
    of the same name, columns of nulls alone) is checkpointed.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    names = [name.lower() for name in df.columns]
    if not names or len(set(names)) < len(names) or any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
