"""Substring dedup with difference-cover anchors.

A word is removed if a window of ``window`` (35) consecutive words that covers it also starts
anywhere else, in the same document or in another. Windows are judged on the input.

Hashing every window would shuffle as many rows as there are words. A difference cover D modulo
v has, for any two positions i and j, an offset d < v with both i + d and j + d in D modulo v. So
only anchors are hashed: windows of ``window - v + 1`` words that begin at cover positions. Two equal
windows share an anchor at the same offset. Anchors that occur twice are sent back to their
documents, and extended there: every full window that holds such an anchor is hashed with 96 bits.
Those that occur twice are the repeated windows, no more and no less.

Both counts pre-aggregate. A task gathers keys, and of equal keys it sends one, marked as known to be
repeated, to the key's bucket; the other places need no counting and are dealt out evenly. So a passage
that a third of all documents hold burdens no task. Keys travel in compressed blocks of byte planes, and a bucket is sorted and
counted with numpy; there are as many buckets as the texts' bytes ask for. The rows are first written with a number each, which
tells them apart whatever their doc_ids and texts are, and of which a block's records share all but the last bytes.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Null and empty texts have none.
Repeated rows count as documents of their own, so they repeat each other; null doc_ids are
kept, however many there are. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from skarn.llm.common import arrow_map, written
from skarn.llm.encoding import batches as text_ranges
from skarn.llm.encoding import drop_encoders

#: A difference cover (fixed values): differences of these give all residues modulo 21.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

BUCKET_BYTES = 1 << 26  # of text to a bucket of keys

#: Bytes of a key. Anchors only filter, so that a few chance repeats do no harm; windows decide.
ANCHOR_KEY, WINDOW_KEY = 6, 12

STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
SECOND_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of word sequences, from prefix sums of word hashes times powers of a step."""

    def __init__(self, step: np.uint64):
        self.step, self.inverse = step, np.uint64(pow(int(step), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def windows(self, hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes)
        if len(self.powers) < n + 1:
            factors = np.ones((2, 2 * n + 1), np.uint64)
            factors[0, 1:], factors[1, 1:] = self.step, self.inverse
            self.powers, self.inverses = np.cumprod(factors, axis=1, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:n], dtype=np.uint64)])
        return mixed((sums[starts + width] - sums[starts]) * self.inverses[starts])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Sender:
    """Gathers (key, document, position) records of a task and sends them in blocks by bucket."""

    def __init__(self, key_bytes: int, buckets: int, most: int = 1 << 20):
        self.key_bytes, self.buckets, self.most = key_bytes, buckets, most
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, key: np.ndarray, check: np.ndarray | None, docs: np.ndarray, position: np.ndarray):
        """``docs``: ``DOCUMENT`` bytes a record that tell its document; yields blocks when enough is held."""
        width = self.key_bytes
        rows = np.empty((len(key), width + DOCUMENT + 4), np.uint8)
        rows[:, : min(width, 8)] = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : min(width, 8)]
        if check is not None:
            rows[:, 8:width] = check.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width - 8]
        rows[:, width : width + DOCUMENT] = docs
        rows[:, width + DOCUMENT :] = position.astype("<u4").view(np.uint8).reshape(-1, 4)
        self.held.append(rows)
        self.size += len(rows)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        rows, width = np.concatenate(self.held), self.key_bytes
        self.held, self.size = [], 0
        order, first = sorted_keys(rows, width)
        starts = np.flatnonzero(first)
        several = np.diff(np.append(starts, len(rows))) > 1
        rows[order[starts[several]], width + FLAGS] |= REPEATED
        # in the order in which they came: rows and positions then compress to next to nothing
        one = rows[np.sort(order[starts])]
        yield self.blocks(one, first_key(one, width) % np.uint64(self.buckets), width, False)
        others = rows[np.sort(order[~first])][:, width:]
        if len(others):
            where = row_bucket(others, self.buckets)
            yield self.blocks(others, where, 0, True)

    def blocks(self, rows: np.ndarray, bucket: np.ndarray, width: int, known: bool):
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        bodies = planes(rows, starts)
        return pa.record_batch(
            [
                pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), known)),
                pa.array(bodies, pa.binary()),
            ],
            names=["bucket", "known", "body"],
        )


#: Bytes that tell a row: its number, and a byte that marks keys of which a task has more.
DOCUMENT, FLAGS = 9, 8
REPEATED = 1


def row_bytes(number: np.ndarray) -> np.ndarray:
    out = np.zeros((len(number), DOCUMENT), np.uint8)
    out[:, :8] = number.astype("<i8").view(np.uint8).reshape(-1, 8)
    return out


def row_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(first_key(rows, 8)) % np.uint64(buckets)


def planes(rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The rows from each start on, as compressed byte planes."""
    packer = ZstdCompressor(level=1)
    return [
        packer.compress(np.ascontiguousarray(rows[a:b].T).tobytes())
        for a, b in zip(starts.tolist(), np.append(starts, len(rows))[1:].tolist(), strict=True)
    ]


def unpacked(body: bytes, width: int) -> np.ndarray:
    """Byte planes, one a row."""
    return np.frombuffer(ZstdDecompressor().decompress(body), np.uint8).reshape(width, -1)


def first_key(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : min(width, 8)] = rows[:, : min(width, 8)]
    return out.view("<u8")[:, 0]


def sorted_keys(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and which of the ordered rows begin a key."""
    key = first_key(rows, width)
    if width <= 8:
        order = np.argsort(key, kind="stable")
        check = None
    else:
        check = first_key(rows[:, 8:width], width - 8)
        order = np.lexsort((check, key))
    first = np.ones(len(rows), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    if check is not None:
        first[1:] |= check[order[1:]] != check[order[:-1]]
    return order, first


def by_document_blocks(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places (documents and positions, no keys) in one block for each bucket of documents."""
    bucket = row_bucket(rows, buckets)
    order = np.lexsort((first_key(rows[:, DOCUMENT:], 4), first_key(rows, 8), bucket))
    rows, bucket = rows[order], bucket[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.record_batch(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(planes(rows, starts), pa.binary())], names=["bucket", "body"]
    )


def repeated_places(sent: DataFrame, key_bytes: int, partitions: int) -> DataFrame:
    """Places whose key occurs more than once: row, places, one row a document."""
    width = DOCUMENT + 4

    def count(all_batches):
        known, keyed = [], []
        for batch in all_batches:
            for is_known, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = width + (0 if is_known else key_bytes)
                (known if is_known else keyed).append(unpacked(body, size))
        found = [x.T for x in known]
        # a part of the keys at a time, where a partition holds very many
        parts = max(1, sum(x.shape[1] for x in keyed) >> 21)
        for part in range(parts):
            some = [x.T if parts == 1 else x.T[x[key_bytes - 1] % parts == part] for x in keyed]
            if not some:
                continue
            rows = np.concatenate(some)
            order, first = sorted_keys(rows, key_bytes)
            rows = rows[order]
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(rows)))
            if len(rows):
                marked = np.maximum.reduceat(rows[:, key_bytes + FLAGS] & REPEATED, starts)
                found.append(rows[np.repeat((counts > 1) | (marked > 0), counts), key_bytes:])
        if found:
            rows = np.concatenate(found)
            rows[:, FLAGS] = 0
            yield by_document_blocks(rows, partitions)

    def gather(all_batches):
        found = [unpacked(body, width).T for batch in all_batches for body in batch.column(1).to_pylist()]
        if not found:
            return
        rows = np.concatenate(found)
        rows = rows[np.argsort(first_key(rows, 8), kind="stable")]
        number = first_key(rows, 8).view(np.int64)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        places = np.ascontiguousarray(rows[:, DOCUMENT:]).view("<u4")[:, 0].astype(np.int32)
        table = pa.table(
            {
                "row": pa.array(number[starts]),
                "places": pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(places)),
            }
        )
        yield from table.to_batches(max_chunksize=4096)

    return (
        sent.repartition(partitions, "bucket").mapInArrow(count, "bucket int, body binary")
        .repartition(partitions, "bucket").mapInArrow(gather, "row long, places array<int>")
    )


def send(docs: DataFrame, key_bytes: int, buckets: int, records) -> DataFrame:
    """Blocks of the records that ``records()`` finds in each batch of ``docs(row, text, ...)``."""

    def run(all_batches):
        drop_encoders()
        find, sender = records(), Sender(key_bytes, buckets)
        for batch in all_batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_ranges(texts):
                part = batch.slice(lo, hi - lo)
                key, check, owner, position = find(part, texts[lo:hi])
                yield from sender.add(key, check, row_bytes(part.column(0).to_numpy())[owner], position)
        yield from sender.flush()

    return docs.mapInArrow(run, "bucket int, known boolean, body binary")


def split_batch(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            own = text.encode().split()
            counts[k] = len(own)
            words += own
    return words, counts


def anchors(window: int, period: int, cover: tuple[int, ...]):
    """Finds the anchors of documents that are long enough to hold a window."""
    width = window - period + 1
    in_cover = np.isin(np.arange(period), cover)
    roll = Rolling(STEP)

    def find(batch: pa.RecordBatch, texts: list[str | None]):
        words, counts = split_batch(texts)
        begins = np.cumsum(counts) - counts
        position = np.arange(len(words)) - np.repeat(begins, counts)
        left = np.repeat(counts, counts) - position
        long_enough = np.repeat(counts >= window, counts)
        at = np.flatnonzero(in_cover[position % period] & (left >= width) & long_enough)
        key = roll.windows(word_hashes(words), at, width)
        return key, None, np.repeat(np.arange(len(counts)), counts)[at], position[at]

    return find


def candidate_windows(window: int, period: int):
    """Finds the windows that hold one of the anchors in the batch's last column."""
    roll, second = Rolling(STEP), Rolling(SECOND_STEP)

    def find(batch: pa.RecordBatch, texts: list[str | None]):
        words, counts = split_batch(texts)
        begins = np.cumsum(counts) - counts
        lists = batch.column(batch.num_columns - 1)
        at = lists.flatten().to_numpy()
        first = np.repeat(begins, np.diff(lists.offsets.to_numpy()))
        at = at + first
        # windows that hold an anchor begin up to period - 1 words before it
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, np.maximum(at - period + 1, first), 1)
        np.add.at(marks, at + 1, -1)
        position = np.arange(len(words)) - np.repeat(begins, counts)
        fits = np.repeat(counts, counts) - position >= window
        start = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & fits)
        hashes = word_hashes(words)
        key, check = roll.windows(hashes, start, window), second.windows(mixed(hashes), start, window)
        return key, check, np.repeat(np.arange(len(counts)), counts)[start], position[start]

    return find


def joined(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    return docs.join(places, docs["row"] == places["row"], how).select(*(docs[c] for c in docs.columns), places["places"])


def repeated_windows(
    docs: DataFrame, window: int = 35, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """Where repeated windows begin: row, places. ``docs``: row (a number of its own), text, ..."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = send(docs.select("row", "text"), ANCHOR_KEY, partitions, lambda: anchors(window, period, cover))
    # all columns are joined here, so that Spark shuffles the texts once for this join and the last one
    candidates = joined(docs, repeated_places(sent, ANCHOR_KEY, partitions), "inner")
    sent = send(candidates, WINDOW_KEY, partitions, lambda: candidate_windows(window, period))
    return repeated_places(sent, WINDOW_KEY, partitions)


def remove_repeated(
    docs: DataFrame, window: int = 35, with_text: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document.

    ``with_text`` adds kept_text: the whole text where nothing is removed, else the kept words joined
    by one space. ``keep`` names further columns to return.
    """
    named = docs.select("text", "doc_id", *(F.col(c).alias(f"_{c}") for c in keep))
    keyed = written(named.select(F.monotonically_increasing_id().alias("row"), *named.columns), "rows")
    # never null, and Spark knows it: a filter for nulls on one side would keep it from shuffling the texts once for both joins
    keyed = keyed.select(F.coalesce("row", F.lit(0)).alias("row"), *named.columns)
    kinds = dict(docs.dtypes)
    places = repeated_windows(keyed, window)

    def make():
        def step(batch: pa.RecordBatch):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                words = (text or "").encode().split()
                removed = 0
                if starts.is_valid and len(starts.values):
                    at = starts.values.to_numpy()
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + window, -1)
                    stays = np.cumsum(marks)[:-1] <= 0
                    removed = int((~stays).sum())
                    kept = b" ".join([words[k] for k in np.flatnonzero(stays)])
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode() if removed else text)
            columns = [batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            columns += [batch.column(3 + k) for k in range(len(keep))]
            yield pa.record_batch(columns, names=[*names, *keep])

        return step

    return arrow_map(
        joined(keyed, places, "left"), make,
        "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        + "".join(f", `{c}` {kinds[c]}" for c in keep),
    )
