"""Where operators cut lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[app]


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_name(id_col: str, results: list[str]) -> str:
    """What a result calls the id: its name, with underscores behind it where the result has a column of that name."""
    while id_col.lower() in {c.lower() for c in results}:
        id_col += "_"
    return id_col


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's own folder: all that is left when it has ended can be deleted with that."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of texts pass 8 MiB, or a row, unless the session has a bound of its own: workers hold batches whole."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(8 << 20))


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Task output is committed file by file, so a lost executor costs only its
    running tasks, and what comes after never recomputes what came before.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Catalyst's size estimate in bytes; for a staged table, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
