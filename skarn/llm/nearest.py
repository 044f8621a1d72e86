"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are dealt to blocks, and each block of queries meets each block of candidates in
one task. There, vectors are quantised to int8 with a scale of their own, and the product of two
tiles gives all squared distances up to an error that the quantisation residues bound. A pair whose lower
bound lies beyond the query's k-th distance so far is out; the others are computed in double precision
from the original vectors and pushed on the query's heap. Nothing true is lost, so that the result is exact.
Block results, k rows a query, are merged by rank.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths never meet. Components may be as large or small as doubles are; a distance beyond them is infinite, and ties with others. A query's own rows (those with its vec_id) are not its candidates. Ties go to the
smaller vec_id. Null vec_ids take no part. A repeated query row gives one result; repeated candidate rows
are candidates each, and rows that share a vec_id are dealt out by their vectors. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import written
from skarn.llm.embedding_dups import component_type, usable

TILE = 1024
LEAST_SLACK = 1e-290  # of squares of vectors whose largest component is about one
QUERY_BYTES = 1 << 26  # of queries to a block


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as floats, for fast products), scales, norms, and norms of the residues."""
    scale = np.maximum(np.abs(rows).max(1) / 127, np.finfo(float).tiny)
    values = np.rint(rows / scale[:, None])
    residue = np.linalg.norm(rows - values * scale[:, None], axis=1)
    kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products stay exact
    return values.astype(np.int8).astype(kind), scale, np.linalg.norm(rows, axis=1), residue


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares leave its range, of differences scaled by a power of two."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        difference = query - rows
        most = np.abs(difference).max(1)
        out = np.sqrt((difference * difference).sum(1))
        for k in np.flatnonzero(((most > 1e150) | (most < 1e-150)) & (most > 0)):
            halves = query / 2 - rows[k] / 2 if most[k] > 1e150 else difference[k]
            power = math.frexp(float(np.abs(halves).max()))[1]
            small = np.ldexp(halves, -power)
            out[k] = np.ldexp(np.sqrt((small * small).sum()), power + (most[k] > 1e150))
    return out


def block_neighbours(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """The k nearest of the block's rows for each query: query_id, vec_id, distance.

    Bounds are taken of both sides scaled by one power of two, so that no square overflows; what a square loses below the range
    is less than the least slack. Distances are of the vectors as they are.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    power = math.frexp(max(float(np.abs(queries).max()), float(np.abs(rows).max())))[1]
    worst = np.full(len(query_ids), np.inf)
    for first in range(0, len(query_ids), TILE):
        some = slice(first, first + TILE)
        own_ids, own_queries, own_worst = query_ids[some], queries[some], worst[some]
        q8, q_scale, q_norm, q_rest = quantised(np.ldexp(own_queries, -power))
        for at in range(0, len(ids), TILE):
            tile_ids, tile = ids[at : at + TILE], rows[at : at + TILE]
            c8, c_scale, c_norm, c_rest = quantised(np.ldexp(tile, -power))
            product = (q8 @ c8.T) * q_scale[:, None] * c_scale[None, :]
            error = q_rest[:, None] * (c_norm + c_rest)[None, :] + q_norm[:, None] * c_rest[None, :]
            squares = q_norm[:, None] ** 2 + c_norm[None, :] ** 2
            middle = squares - 2 * product
            slack = 2 * error + 1e-9 * squares + LEAST_SLACK
            own = own_ids[:, None] == tile_ids[None, :]
            limit = np.ldexp(own_worst, -power) ** 2
            if len(tile_ids) > k:  # at least k candidates lie within the k-th upper bound
                upper = np.where(own, np.inf, middle + slack)
                limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
            near = (middle - slack <= limit[:, None] * (1 + 1e-9)) & ~own
            for i in np.flatnonzero(near.any(1)):
                at_most = np.flatnonzero(near[i])
                exact = distances(own_queries[i], tile[at_most])
                best = np.lexsort((tile_ids[at_most], exact))[:k]  # of a large group of ties too
                heap = heaps[first + i]
                for j in best:
                    entry = (-float(exact[j]), -int(tile_ids[at_most[j]]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    else:
                        break
                if len(heap) == k:
                    own_worst[i] = -heap[0][0]
    return [
        (int(q), -i, -d) for q, heap in zip(query_ids, heaps, strict=True) for d, i in heap
    ]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int | None = None, candidate_rows: int = 16384
) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` for each of ``queries(vec_id, embedding)``.

    Each candidate is sent once for each block of queries, so that these are as large as memory allows (``QUERY_BYTES``, if
    ``query_rows`` is not given).

    Returns query_id, rank int (from 1), vec_id, score (the Euclidean distance).
    """
    kinds = component_type(vectors), component_type(queries)

    def size(kind: str):
        return (F.octet_length("vector") / np.dtype(kind).itemsize).cast("int")

    candidates = written(usable(vectors.where("vec_id is not null"), "vec_id").withColumn("size", size(kinds[0])), "vectors")
    asked = written(
        usable(queries.where("vec_id is not null"), "vec_id").dropDuplicates(["vec_id"]).withColumn("size", size(kinds[1])), "queries"
    )
    told = asked.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    query_rows = query_rows or max(TILE, QUERY_BYTES // (8 * (told["size"] or 1)))
    query_blocks = max(1, -(-told["n"] // query_rows))
    blocks = max(1, -(-candidates.count() // candidate_rows))

    def both(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (
            df.withColumn(own, F.pmod(F.xxhash64("vec_id", "vector", F.lit(own)), F.lit(n_own)))
            .withColumn(other, F.explode(F.expr(f"sequence(0L, {n_other - 1}L)")))
            .groupBy("size", "_q", "_c")
        )

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            size = left.column("size")[0].as_py()
            matrix = [
                np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(-1, size).astype(np.float64)
                for t, kind in ((left, kinds[1]), (right, kinds[0]))
            ]
            ids = [t.column("vec_id").to_numpy() for t in (left, right)]
            found = block_neighbours(ids[0], matrix[0], ids[1], matrix[1], k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table(
            {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}
        )

    found = (
        both(asked, "_q", query_blocks, "_c", blocks)
        .cogroup(both(candidates, "_c", blocks, "_q", query_blocks))
        .applyInArrow(join, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
