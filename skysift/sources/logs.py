"""Log files: those written since a time, as one table of lines in order."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranks import row_ids


def scan(spark: SparkSession, path: str, start: datetime) -> DataFrame:
    """(line, value): the lines of all files under ``path`` modified after ``start``, file after file by path, numbered from 0."""
    reader = spark.read.option("recursiveFileLookup", "true").option("timeZone", "UTC")
    lines = reader.option("modifiedAfter", start.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")).text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return row_ids(lines.select("value", place.alias("_place")), "_place", name="line").select("line", "value")


def pause(spark: SparkSession, path: str) -> datetime:
    """A whole second after which nothing under ``path`` was modified yet: the next one but one."""
    time.sleep(1.2 - time.time() % 1)
    now = datetime.now(timezone.utc).replace(microsecond=0)
    time.sleep(1.2 - time.time() % 1)
    return now
