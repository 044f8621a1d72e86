"""Best-fit packing of tokenized documents into sequences of a fixed size.

The packing solves the configuration linear program over the histogram of piece lengths:
columns are multisets of lengths that fit one sequence, and the least number of sequences
must cover every length as often as it occurs. Multiplicative weights on the lengths
solve it, with a knapsack dynamic program that finds the column of most weight in each
round. The fractional solution is rounded down; the few pieces left over are placed by
best fit. The histogram has at most ``size`` entries, so that the driver's share of the work
does not grow with the corpus; pieces are dealt to their places by rank, on the executors.

Null texts count as empty; an empty document is one piece that holds only the end id.
Repeated rows are packed once for each. A null doc_id is kept. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, written
from skarn.llm.encoding import batches, bulk_encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """The pieces of each document; only documents longer than ``size`` are cut.

    A cut document begins with its shorter piece, all others are full.
    """

    def make():
        encoder = bulk_encoder(tokenizer)

        def step(batch: pa.RecordBatch):
            doc_ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            nulls = np.asarray(batch.column(0).is_null())
            texts = texts.to_pylist()
            for lo, hi in batches(texts):
                ids, offsets = encoder.encode(texts[lo:hi])
                rows = []
                for k in range(hi - lo):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id))
                    own = own.astype("<u4", copy=False)
                    doc = None if nulls[lo + k] else int(doc_ids[lo + k])
                    start, end = 0, len(own) % size or size
                    for piece in range(-(-len(own) // size)):
                        end = min(end, len(own))
                        crc = zlib.crc32(own[start:end])
                        rows.append((doc, piece, start, end - start, crc))
                        start, end = end, end + size
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

        return step

    return arrow_map(docs.select("doc_id", "text"), make, PIECES)


class Knapsack:
    """Multisets of lengths of most weight for every room up to ``size``."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, size: int):
        self.lengths, self.weights = lengths, weights
        self.best = best = np.zeros(size + 1)
        self.choice = choice = np.full(size + 1, -1, np.int64)
        for room in range(int(lengths[0]), size + 1):
            n = np.searchsorted(lengths, room, side="right")
            gains = best[room - lengths[:n]] + weights[:n]
            k = int(gains.argmax())
            best[room] = best[room - 1]
            if gains[k] > best[room]:
                best[room], choice[room] = gains[k], k

    def column(self, first: int, size: int) -> Counter:
        """The best multiset that holds length number ``first``; by number of the length."""
        column, room = Counter({first: 1}), size - int(self.lengths[first])
        while room > 0:
            k = int(self.choice[room])
            if k < 0:
                room -= 1
            else:
                column[k] += 1
                room -= int(self.lengths[k])
        return column


def fractional_columns(
    histogram: dict[int, int], size: int, rounds: int, rate: float, near: float = 0.05
) -> tuple[dict[tuple, float], float]:
    """Columns with multiplicities that cover the histogram, and a lower bound.

    Each round prices the columns by the dynamic program and spreads its mass over the best
    column that holds each length, as far as that is within ``near`` of the best of all: in
    proportion to the demand. A length's weight falls exponentially with its coverage ahead
    of the rounds so far, and rises as it lags. By duality, the demand's total weight over
    the best column's weight bounds the number of sequences from below.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], float)
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    bound = 0.0
    for done in range(rounds):
        weights = lengths / size * np.exp(rate * (done / rounds - covered))
        prices = Knapsack(lengths, weights, size)
        bound = max(bound, float(demand @ weights) / prices.best[size])
        value = weights + prices.best[size - lengths]
        lag = np.maximum(0.0, (done + 1) / rounds - covered)
        for k in np.flatnonzero((value >= (1 - near) * value.max()) & (lag > 0)):
            lacks = (done + 1) / rounds - covered[k]  # what this round's columns left of it
            if lacks <= 0:
                continue
            column = prices.column(int(k), size)
            where, times = np.array(list(column)), np.array(list(column.values()), float)
            step = lacks * demand[k] / column[int(k)]
            covered[where] += times * step / demand[where]
            key = tuple(sorted(zip(lengths[where].tolist(), column.values(), strict=True), reverse=True))
            found[key] = found.get(key, 0.0) + step
    return found, bound


def rounded_down(
    columns: dict[tuple, float], demand: dict[int, int], size: int
) -> tuple[Counter, dict[int, int]]:
    """Whole columns, and the pieces left over; lengths that are covered in excess drop out."""
    plan: Counter = Counter()
    rest = dict(demand)
    for column in sorted(columns, key=lambda k: (-columns[k], k)):
        count, now = int(columns[column] + 1e-9), column
        full = sum(x * n for x, n in column)
        while count and now:
            times = min(count, *(rest[x] // n for x, n in now))
            if times:
                plan[now] += times
                count -= times
                for x, n in now:
                    rest[x] -= n * times
            now = tuple((x, min(n, rest[x])) for x, n in now if rest[x])
            if sum(x * n for x, n in now) < 0.97 * full:
                break
    return plan, rest


def best_fit(rest: dict[int, int], size: int) -> list[Counter]:
    """Best fit, longest first, for the pieces that rounding leaves over."""
    bins: list[Counter] = []
    by_room: dict[int, list[int]] = {}
    rooms = np.zeros(size + 1, np.int64)  # open bins by room
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                k = by_room[room].pop()
                rooms[room] -= 1
            else:
                k, room = len(bins), size
                bins.append(Counter())
            bins[k][length] += 1
            by_room.setdefault(room - length, []).append(k)
            rooms[room - length] += 1
    return bins


def plan_columns(
    histogram: dict[int, int], size: int, rounds: int = 400, rate: float = 0.5
) -> list[tuple[tuple, int]]:
    """Whole columns that hold exactly the pieces of the histogram, each with its count."""
    full = histogram.get(size, 0)
    demand = {x: n for x, n in histogram.items() if n and x < size}
    plan: Counter = Counter()
    if full:
        plan[((size, 1),)] = full
    if demand:
        columns, _ = fractional_columns(demand, size, rounds, rate)
        whole, rest = rounded_down(columns, demand, size)
        plan.update(whole)
        for one in best_fit(rest, size):
            plan[tuple(sorted(one.items(), reverse=True))] += 1
    return sorted(plan.items())


def places(plan: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for column, count in plan:
        offset = 0
        for length, times in column:
            for _ in range(times):
                rows.append((length, used[length], count, sequence, offset))
                used[length] += count
                offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, size: int = 1024,
    rounds: int = 400, group_rows: int = 50_000,
) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of at most ``size`` tokens.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    ``group_rows``: pieces of one length are ranked in groups of about so many rows, so that no
    task holds all pieces of a common length.
    """
    tokenizer = tokenizer or tokenizer_path()
    # the number of a row is settled with the table, and deals out rows that are equal in all else
    pieces = written(token_pieces(docs, tokenizer, end_id, size).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {
        int(r["length"]): int(r["n"])
        for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # <= size rows
    }
    total = sum(histogram.values())
    where = places(plan_columns(histogram, size, rounds))
    groups = max(8, total // group_rows)
    grouped = pieces.withColumn(
        "_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")
    )
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
        .select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy("length", "_group").orderBy("_row")
    ranked = (
        grouped.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "_group"])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("_first") + F.col("_rank")).alias("_rank"),
        )
    )

    def make():
        keys = (where[:, 0] << 44) + where[:, 1]

        def step(batch: pa.RecordBatch):
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = where[k, 3] + rank - where[k, 1]
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(where[k, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

        return step

    return arrow_map(ranked, make, PIECES + ", sequence_id long, offset long")
