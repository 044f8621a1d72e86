"""Connected components of an edge table, by alternating star contractions.

Each round attaches the neighbours of every node to the least node that it sees, first those
above it (large star), then those below it (small star), until nothing changes; a graph of n
nodes takes a number of rounds that grows with log(n). Nodes and edges stay distributed: only
counts and checksums reach the driver. Each round ends in a checkpoint, so that plans stay short and a lost
executor costs one round at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HUBS = 256  # nodes whose pairs may be kept out of a shuffle at most


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept in the folder that the session names in ``spark.checkpoint.dir``.

    Only on one machine, where the session names none (as in tests), is a temporary folder taken; on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        master = spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skarn-"))
    return df.checkpoint()


def spread_join(rows: DataFrame, values: DataFrame, key: str, n: int, count: str = "_n") -> DataFrame:
    """The rows with the values of their key; ``values``: the key, once each, what to add, and how many rows have it (``count``).

    Of ``n`` rows, those of a hub, a key with more than n / ``HUBS`` of them, do not meet in one task: there are fewer than ``HUBS`` such
    keys, so that their values are broadcast.
    """
    hub = F.col(count) > max(n // HUBS, HUBS)
    added = [c for c in values.columns if c not in (key, count)]
    hubs = F.broadcast(values.where(hub).select(key, F.struct(*added).alias("_hub")))
    marked = rows.join(hubs, key, "left")
    rest = marked.where("_hub is null").drop("_hub").join(values.where(~hub).drop(count), key).select(*rows.columns, *added)
    return rest.unionByName(marked.where("_hub is not null").select(*rows.columns, *[F.col(f"_hub.{c}").alias(c) for c in added]))


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """Adds to each of ``n`` pairs (a, b) the least ``m`` of a and all b of that a."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    return spread_join(pairs, least, "a", n)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: ``node``, ``component`` (the least node reachable).

    Only nodes with an edge to another node are returned. Null ends, self loops and repeated edges
    are ignored; an empty table gives an empty result. Nodes may be of any ordered type.
    """
    now = (
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    now = checkpointed(now)
    seen = (now.count(), None)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = checkpointed(
            _with_least(both, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct()
        )
        small = _with_least(large, seen[0])
        now = checkpointed(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .where("a != b").distinct()
        )
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if seen == (state["n"], state["s"]):
            break
        seen = (state["n"], state["s"])
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
