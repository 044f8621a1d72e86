"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Within a label, vectors link at a cosine of ``threshold`` or more. Unit vectors that link lie within
d = sqrt(2 - 2 cos) of each other, so that on a random direction in n dimensions their projections differ
by about d / sqrt(n), whatever the rest of the vectors. The operator

1. merges equal vectors, so that copies never meet pair by pair;
2. projects each vector on many random directions. Each of ``tables`` sorted lists is ordered by one
   projection, within cells of ``cells`` others, so that far vectors seldom share a list;
3. takes the pairs whose sorted projections lie in a query-centred window of each other, and counts
   in how many of ``projections`` further projections the pair collides in such a window;
4. verifies pairs that pass the count by their cosine in double precision.

The count is calibrated on the worst linking pair, one exactly at the threshold: it loses such a pair
with a chance of at most ``miss``, and the lists together lose one in about two million at the default
settings. A pair in several lists belongs to the first of them, so that it counts once and no pairs are shuffled.
Cells with over ``cell_rows`` rows are split, and parts meet two at a time, so that no task holds a whole
hot cell. A task returns sums of links and a spanning forest, not its pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths never link. Equal vectors link with each other. Repeated rows count as
vectors of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, written
from skarn.llm.simhash import forest
from skarn.operators.components import connected_components, spread_join

PAIRS = 1 << 17  # compared at once


def component_type(vectors: DataFrame) -> str:
    """The numbers as they are stored: single precision travels in half the bytes of double."""
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def usable(vectors: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``embedding`` can be compared, with it as ``vector``: bytes of ``component_type``."""
    stored = component_type(vectors)

    def make():
        def step(batch: pa.RecordBatch):
            rows, data = [], []
            for k, v in enumerate(batch.column(len(columns)).to_pylist()):
                if v and None not in v:
                    v = np.array(v, stored)
                    if np.isfinite(v).all() and v.any():
                        rows.append(k)
                        data.append(v.tobytes())
            kept = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [*(batch.column(k).take(kept) for k in range(len(columns))), pa.array(data, pa.binary())],
                names=[*columns, "vector"],
            )

        return step

    kinds = dict(vectors.dtypes)
    return arrow_map(
        vectors.select(*columns, "embedding"), make,
        ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", vector binary",
    )


class Lists:
    """The random directions of vectors of one length, and what is calibrated on them."""

    def __init__(self, size: int, threshold: float, tables: int, cells: int, projections: int, miss: float):
        random = np.random.Generator(np.random.PCG64(20_240_607))
        near = math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(size)  # of a projection's difference
        directions = random.standard_normal((size, tables * (cells + 1) + projections))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        self.shape = (tables, cells)
        self.width = 10 * near or 1e-9
        self.shift = random.random(tables * cells) * self.width
        self.window = 2.5 * near + 1e-9
        inside = math.erf(2.5 / math.sqrt(2)) - 0.002  # a margin for directions in few dimensions
        chance, self.count = 0.0, projections
        for lost in range(projections + 1):  # the largest count that loses no more than ``miss``
            chance += math.comb(projections, lost) * inside ** (projections - lost) * (1 - inside) ** lost
            if 1 - chance <= miss:
                self.count = projections - lost
                break

    def project(self, units: np.ndarray):
        """Cell of each list, sorted projection of each list, further projections."""
        tables, cells = self.shape
        values = units @ self.directions
        grid = np.floor((values[:, : tables * cells] + self.shift) / self.width).astype(np.int64)
        grid = grid.reshape(len(units), tables, cells)
        key = np.zeros((len(units), tables), np.uint64)
        for k in range(cells):
            key = (key ^ grid[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64), values[:, tables * cells : tables * (cells + 1)], values[:, tables * (cells + 1) :]


def unit_rows(data: list[bytes], stored: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), stored).reshape(len(data), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, tables: int = 12, cells: int = 4, projections: int = 32,
    miss: float = 1e-6, cell_rows: int = 4096,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``."""
    settings = (threshold, tables, cells, projections, miss)
    stored = component_type(vectors)
    width = np.dtype(stored).itemsize
    rows = written(
        usable(vectors.where("label is not null"), "vec_id", "label")
        .withColumn("node", F.xxhash64("label", "vector")), "vectors",
    )
    nodes = written(
        rows.groupBy("node", "label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "nodes"
    )

    def spread():
        made: dict[int, Lists] = {}

        def step(batch: pa.RecordBatch):
            data = batch.column(2).to_pylist()
            sizes = np.array([len(d) for d in data], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                lists = made.setdefault(int(size), Lists(int(size) // width, *settings))
                key, _, _ = lists.project(unit_rows([data[k] for k in at], stored))
                n = len(at)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, tables))),
                        batch.column(1).take(pa.array(np.repeat(at, tables))),
                        pa.array(np.full(n * tables, size // width, np.int32)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(key.reshape(-1)),
                    ],
                    names=["node", "label", "size", "list", "cell"],
                )

        return step

    label_type = dict(vectors.dtypes)["label"]
    places = arrow_map(
        nodes.select("node", "label", "vector"), spread,
        f"node long, label {label_type}, size int, list int, cell long",
    ).withColumn("place", F.xxhash64("label", "size", "list", "cell"))
    sizes = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("node", "list"), F.col("parts")).cast("int")
    dealt = (
        places.join(sizes, "place").withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select(
            "node", "list", "own",
            F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
            (F.col("own") == F.col("other")).alias("alone"),
        )
        .join(nodes.select("node", "label", "vector", "copies"), "node")
    )

    def compare(all_batches):
        made: dict[int, Lists] = {}
        held: list = []

        def pairs(values: np.ndarray, own: np.ndarray, alone: np.ndarray, window: float):
            """Pairs in each other's window; of a tile of two parts, those across them."""
            order = np.argsort(values, kind="stable")
            ends = np.searchsorted(values[order], values[order] + window, side="right")
            counts = ends - np.arange(len(order)) - 1
            at = 0
            while at < len(order):
                most = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS, side="right")) + at)
                some = counts[at:most]
                i = np.repeat(np.arange(at, most), some)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
                i, j = order[i], order[j]
                keep = (own[i] != own[j]) | (alone[i] & alone[j])
                yield i[keep], j[keep]
                at = most

        def tile(rows: list[tuple]):
            node = np.array([r[0] for r in rows], np.int64)
            number, own = rows[0][1], np.array([r[2] for r in rows], np.int64)
            alone = np.array([r[4] for r in rows], bool)
            copies = np.array([r[7] for r in rows], np.int64)
            data = [r[6] for r in rows]
            size = len(data[0]) // width
            lists = made.setdefault(size, Lists(size, *settings))
            units = unit_rows(data, stored)
            key, values, further = lists.project(units)
            links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for i, j in pairs(values[:, number], own, alone, lists.window):
                hits = np.zeros(len(i), np.int16)
                for k in range(projections):
                    hits += np.abs(further[i, k] - further[j, k]) <= lists.window
                passed = hits >= lists.count
                i, j = i[passed], j[passed]
                earlier = np.zeros(len(i), bool)  # the pair belongs to the first list that has it
                for k in range(number):
                    earlier |= (key[i, k] == key[j, k]) & (np.abs(values[i, k] - values[j, k]) <= lists.window)
                i, j = i[~earlier], j[~earlier]
                linked = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
                i, j = i[linked], j[linked]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    label = forest(len(rows), np.concatenate([np.arange(len(rows)), i]), np.concatenate([label, j]))
            some = np.flatnonzero(links)
            return node[some], node[label[some]], links[some]

        def result(found: list[tuple]):
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            return pa.record_batch([pa.array(c) for c in columns], names=["node", "root", "links"])

        for batch in all_batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[3] != held[0][3]:
                    if len(held) > 1:
                        found.append(tile(held))
                    held = []
                held.append(row)
            if found:
                yield result(found)
        if len(held) > 1:
            yield result([tile(held)])

    found = written(
        dealt.select("node", "list", "own", "tile", "alone", "label", "vector", "copies")
        .repartition("tile").sortWithinPartitions("tile")
        .mapInArrow(compare, "node long, root long, links long"),
        "links",
    )
    groups = connected_components(found, "node", "root")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = (
        nodes.select("node", "copies", "first_id").join(sums, "node", "left")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    n = rows.count()
    names = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n"))
    named = spread_join(labelled, names, "component", n).select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"
    )
    linked = spread_join(rows.select("vec_id", "node"), named, "node", n, "copies").select("vec_id", "n_links", "component_id")
    # rows that can link with nothing stand alone
    valid = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    alone = vectors.where(~F.coalesce(valid, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
