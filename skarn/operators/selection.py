"""First, latest, best and k best of groups, runs, and exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.components import checkpointed


def latest_per_key(df: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key, and how many others it had (``n_skipped``).

    Aggregates a struct, so that partial results are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(newest)], F.struct(*rest).alias("_row")))
    found = df.groupBy(*key).agg(best.alias("_best"), (F.count("*") - 1).alias("n_skipped"))
    return found.select(*key, "_best._row.*", "n_skipped")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Aggregates a struct, so that partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)]))
    return df.groupBy(*key).agg(first.alias("_first")).select(*key, "_first.*")


def members_of_groups(df: DataFrame, key: str, first: Column, order: Column) -> DataFrame:
    """The rows whose key is not null and occurs more than once, with ``n`` and ``first`` (of the row that comes first by ``order``)."""
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min_by(first, order).alias("first")).where("n > 1")
    return df.join(grouped, key)


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key; Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def runner_up_margin(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Adds ``margin``: the score less the key's second highest; 1.0 for a single candidate."""
    whole = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value(score, 2).over(whole)
    return df.withColumn("_second", second).withColumn(
        "margin", F.when(F.col("_second").isNull(), 1.0).otherwise(F.col(score) - F.col("_second"))
    ).drop("_second")


def global_rank(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row in a total order.

    Rows are dealt out by ranges of the whole order, so that no value of its first column makes one task; a row's place is that in its range and
    the sizes of the ranges before it. The ranges are settled before they are counted.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumns({"_range": F.spark_partition_id(), "_inside": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = dealt.join(F.broadcast(firsts), "_range")  # as many rows as partitions
    return ranked.withColumn(place, F.col("_inside") + F.col("_first") + 1).drop("_range", "_inside", "_first")


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of neighbouring rows with an equal value: adds ``run`` (from 0)."""
    window = Window.partitionBy(*key).orderBy(*order)
    begins = (~F.col(value).eqNullSafe(F.lag(value).over(window))).cast("int")
    first = F.row_number().over(window) == 1
    return (
        df.withColumn("_b", F.when(first, 0).otherwise(begins)).withColumn("run", F.sum("_b").over(window)).drop("_b")
    )


SLICES = 1024  # of a range of values, in each round of the search for a rank


def exact_median(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, ``n``, ``median`` (mean of the middle two).

    The values of both middle ranks are searched for by counts: two rounds cut the range of a key's values into slices and keep the one that holds
    the rank, so that only a millionth of the range is sorted, and no task sees all values of a key.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    sizes = rows.groupBy(*key).agg(F.sum("_c").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))))
    searched = sizes.select(*key, "n", "_low", "_high", middle.alias("_rank")).withColumn("_which", F.col("_rank"))
    ids = [*key, "_which"]
    for _ in range(2):
        inside = rows.join(searched, key).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
        sliced = inside.withColumn("_slice", F.coalesce(F.floor(share * (SLICES - 1)), F.lit(0))).groupBy(*ids, "n", "_rank", "_slice").agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = F.sum("_c").over(Window.partitionBy(*ids).orderBy("_slice"))  # as many rows as slices
        found = sliced.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
        searched = found.select(*ids, "n", "_low", "_high", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"))
    left = rows.join(searched, key).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    upto = F.sum("_c").over(Window.partitionBy(*ids).orderBy("_v"))
    values = left.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
    return values.groupBy(*key).agg(F.max("n").alias("n"), ((F.min("_v") + F.max("_v")) / 2).alias("median"))


def import_window(df: DataFrame, key: list[str], at: str, days: int = 7, coverage: float = 0.5) -> DataFrame:
    """The window in which most rows of a key were created: those within ``days`` of the median.

    Returns key, n, n_inside, window_start, window_end (numbers; null if under ``coverage`` lie inside).
    """
    middle = exact_median(df, key, at)
    inside = F.abs(F.col(at) - F.col("median")) <= days * 86400
    found = df.where(F.col(at).isNotNull()).join(middle, key).groupBy(*key).agg(
        F.max("n").alias("n"), F.count_if(inside).alias("n_inside"),
        F.min(F.when(inside, F.col(at))).alias("_a"), F.max(F.when(inside, F.col(at))).alias("_b"),
    )
    enough = F.col("n_inside") / F.col("n") >= coverage
    return found.select(
        *key, "n", "n_inside", F.when(enough, F.col("_a")).alias("window_start"), F.when(enough, F.col("_b")).alias("window_end")
    )
