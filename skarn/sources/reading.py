"""Reading tables for work that costs far more than moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan, dealt evenly where the scan has fewer partitions than the cluster has cores.

    Files of one row group are one task each. For parsers and tokenizers a shuffle of such a small input is cheap;
    an input with enough partitions is left as it is. Only for scans: with a shuffle below, asking for the number of partitions
    would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
