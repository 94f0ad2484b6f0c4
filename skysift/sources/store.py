"""Tables that operators write to cut lineage or to fix partitions, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder in ``spark.checkpoint.dir``; where that is unset and all runs on one machine, as in tests, in a folder of our own.

    What queries read later stays there; when the application has ended its folder can be deleted.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-skysift-"))
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: what is in which row no longer depends on a recomputation."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
