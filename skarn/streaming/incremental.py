"""Comparison of collections that arrive over time (an addition of this engine: the rules themselves are batch).

A stream of records is normalized and its digests are counted with a watermark; each batch is linked to a fixed target by
unique digest, so that new arrivals are reported without a full comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import hashing, text
from skarn.operators.joins import only_unique


def digests(records: DataFrame, record_id: str, body: str, at: str) -> DataFrame:
    return records.select(F.col(record_id).alias("id"), at, hashing.digest(text.normalize_text(F.col(body))).alias("digest"))


def linked(stream: DataFrame, target: DataFrame) -> DataFrame:
    """Arrivals with the target row that alone has their digest."""
    return stream.join(only_unique(target.select(F.col("id").alias("target_id"), "digest"), "digest"), "digest")


def arrivals(stream: DataFrame, at: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Arrivals and repeated digests by window of time."""
    seen = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])
    return seen.groupBy(F.window(at, every)).agg(F.count("*").alias("n_new"))
