"""Token ids in entropy-coded files: canonical Huffman codes from the corpus' own counts.

Layout of a token folder:

- ``codebook``: one row an id that occurs, with the length of its code. Codes are canonical
  (by length, then id) and at most ``limit`` bits long (package-merge), so the lengths are all
  that a reader needs.
- ``blocks``: Parquet rows, one an independent block, in files that each hold a range of
  doc_ids: file_no, block_no (both ascend with doc_id), doc_ids, doc_tokens, payload and
  checkpoints. Parquet is only the container: its own compression is off. In a payload each
  document begins at a whole byte, bits run from the highest of a byte to the lowest, and
  ``checkpoints`` holds the bit offset in the payload of every ``stride``-th id of each document.
- ``format``: one row with the format's version, stride and limit.

A reader decodes all stretches between checkpoints in lockstep by one table look-up an id.

Null texts count as empty and hold only the end id. A null doc_id sorts first. Repeated doc_ids
stay side by side, in one file or, where they are very many, in neighbouring ones. Extra columns are ignored. An empty table gives a folder
without blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, new_folder, written
from skarn.llm.encoding import batches, bulk_encoder, tokenizer_path

VERSION = 1
STRIDE = 256
LIMIT = 18
NO_ID = -(1 << 63)  # stands for a null doc_id where files are dealt out
BLOCK_TOKENS = 1 << 19
FILE_TOKENS = 1 << 23
MOST_FILES = 50_000  # their bounds are found on the driver; beyond it files hold more
BLOCKS = (
    "file_no int, block_no int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "checkpoints array<long>, payload binary"
)


def file_numbers(cuts: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """The file of each row, ascending with doc_id; rows of a doc_id that fills several files are dealt to them in turn."""
    last = np.searchsorted(cuts, doc_ids, side="right")
    first = np.searchsorted(cuts, doc_ids, side="left")
    exact = (np.abs(doc_ids) < 1 << 53) | (doc_ids == NO_ID)  # cuts are found in double precision
    first = np.where(exact, first, last)
    return first + np.arange(len(doc_ids)) % (last - first + 1)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)  # which of the sorted items are leaves
        merged = merged[order]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs].reshape(-1, 2).sum(1)
    take, own = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        own[:taken] += 1
        take = 2 * (take - taken)
    lengths[used] = own
    return lengths


class Code:
    """The canonical code of given lengths, with the tables to write and to read it."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.width = int(self.lengths.max()) if len(lengths) else 1
        # each code takes 2^(width - length) places of the table, one after another
        self.places = np.int64(1) << (self.width - self.lengths)
        self.first = np.cumsum(self.places) - self.places

    def writer(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.symbols] = (self.first >> (self.width - self.lengths)).astype(np.uint64)
        length[self.symbols] = self.lengths
        return code, length

    def reader(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``width`` bits."""
        symbol, length = np.zeros(1 << self.width, np.uint32), np.zeros(1 << self.width, np.uint8)
        filled = int(self.places.sum())
        symbol[:filled] = np.repeat(self.symbols, self.places)
        length[:filled] = np.repeat(self.lengths, self.places)
        return symbol, length


def huffman_encode(
    ids: np.ndarray, offsets: np.ndarray, code: np.ndarray, length: np.ndarray, stride: int
):
    """Bytes of all documents, where each begins, and its bit offsets of every stride-th id.

    Bits are gathered in words of 64: codes of a word never meet, so that their sum is their
    union. A code that crosses into the next word leaves its low bits there.
    """
    bits = length[ids]
    ends = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
    doc_bytes = (np.diff(ends[offsets]) + 7) // 8
    starts = np.concatenate([[0], np.cumsum(doc_bytes)])
    shift = 8 * starts[:-1] - ends[offsets[:-1]]
    position = ends[:-1] + np.repeat(shift, np.diff(offsets))
    word, room = position >> 6, 64 - (position & 63) - bits  # room left to the right of a code
    value = code[ids]
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(starts[-1]) // 8 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        out[word[first]] = np.add.reduceat(high, first)
    over = np.flatnonzero(room < 0)  # one code at most leaves a word
    out[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    marks = [ends[a:b:stride] - ends[a] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out.astype(">u8").view(np.uint8)[: int(starts[-1])], starts, marks


def huffman_decode(
    payload: np.ndarray, begins: np.ndarray, counts: np.ndarray, symbol: np.ndarray,
    length: np.ndarray, width: int,
) -> np.ndarray:
    """Ids of stretches that begin at the given bits and hold so many ids each, in lockstep."""
    padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    order = np.argsort(-counts, kind="stable")
    place, position, counts = (ends - counts)[order], begins[order].copy(), counts[order]
    alive = len(order)
    for k in range(int(counts[0]) if alive else 0):
        while counts[alive - 1] <= k:
            alive = int(np.searchsorted(-counts, -k, side="left"))
        now = position[:alive]
        next_bits = (window[now >> 3] << (now & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[place[:alive] + k] = symbol[next_bits]
        position[:alive] = now + length[next_bits]
    return out


def stage_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document as little-endian integers of 16 bits, or 32 for large vocabularies."""

    def make():
        encoder = bulk_encoder(tokenizer)
        kind = id_type(encoder.library.get_vocab_size())

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                ids, offsets = encoder.encode(texts[lo:hi])
                width, ends, raw = np.dtype(kind).itemsize, offsets.tolist(), ids.astype(kind).tobytes()
                last = np.array([end_id], kind).tobytes()
                data = [raw[width * a : width * b] + last for a, b in zip(ends[:-1], ends[1:], strict=True)]
                offsets = offsets + np.arange(len(offsets))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(data, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def stored_ids(column: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows of a binary column; its bytes lie side by side."""
    if not len(column):
        return np.empty(0, kind)
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[at : at + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def count_ids(staged: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """Occurrences of each id; a task sends one sum for each id at most."""

    def run(all_batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in all_batches:
            total += np.bincount(stored_ids(batch.column(0), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    sums = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in sums.collect():  # one row for each id of the vocabulary at most
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
    limit: int = LIMIT, stride: int = STRIDE, block_tokens: int = BLOCK_TOKENS,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Encodes ``docs(doc_id, text)`` and writes a token folder in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = id_type(vocabulary)
    staged = written(stage_ids(docs, tokenizer, end_id), "ids", "snappy")  # ids hardly compress, and zstd takes its time to find out
    counts = count_ids(staged, kind, vocabulary)
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    code = Code(used, lengths[used])
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in used], "id long, length int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    spark.createDataFrame(
        [(VERSION, stride, code.width)], "version int, stride int, width int"
    ).coalesce(1).write.parquet(f"{path}/format")

    files = min(MOST_FILES, max(1, -(-int(counts.sum()) // file_tokens)))
    ids = staged.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    cuts = np.array(
        ids.approxQuantile("doc_id", [k / files for k in range(1, files)], 0.2 / files) if files > 1 else []
    ).astype(np.int64)

    def make():
        table, bits = code.writer()

        def step(batch: pa.RecordBatch):
            n = np.asarray(batch.column(1))
            most = max(1, int(np.ceil(n.sum() / (1 << 17))))  # arrays that fit a core's cache
            for part in np.array_split(np.arange(len(n)), most):
                if not len(part):
                    continue
                lo, hi = int(part[0]), int(part[-1]) + 1
                ids = stored_ids(batch.column(2).slice(lo, hi - lo), kind)
                offsets = np.concatenate([[0], np.cumsum(n[lo:hi])])
                data, starts, marks = huffman_encode(ids, offsets, table, bits, stride)
                doc_ids = batch.column(0).slice(lo, hi - lo)
                file_no = file_numbers(cuts, doc_ids.fill_null(NO_ID).to_numpy())
                raw, ends = data.tobytes(), starts.tolist()
                bodies = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(file_no.astype(np.int32)), doc_ids, pa.array(n[lo:hi]),
                        pa.array(marks, pa.list_(pa.int64())), pa.array(bodies, pa.binary()),
                    ],
                    names=["file_no", "doc_id", "n_tokens", "marks", "body"],
                )

        return step

    coded = arrow_map(
        staged, make, "file_no int, doc_id long, n_tokens long, marks array<long>, body binary"
    )

    def blocks(all_batches):
        """Neighbouring documents of a file, until they hold ``block_tokens`` ids."""
        held: list[tuple] = []
        now, number, size = None, 0, 0

        def block():
            at = np.cumsum([0] + [8 * len(h[3]) for h in held])[:-1]
            marks = np.concatenate([np.asarray(h[2], np.int64) + a for h, a in zip(held, at, strict=True)])
            row = (now, number, size, [h[0] for h in held], [h[1] for h in held], marks, b"".join(h[3] for h in held))
            return pa.record_batch(
                [
                    pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.int64()),
                    pa.array([row[3]], pa.list_(pa.int64())), pa.array([row[4]], pa.list_(pa.int64())),
                    pa.array([row[5]], pa.list_(pa.int64())), pa.array([row[6]], pa.binary()),
                ],
                names=["file_no", "block_no", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload"],
            )

        for batch in all_batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != now or size >= block_tokens):
                    yield block()
                    number = number + 1 if row[0] == now else 0
                    held, size = [], 0
                elif row[0] != now:
                    number = 0
                now = row[0]
                held.append(row[1:])
                size += row[2]
        if held:
            yield block()

    (
        coded.repartition(files, "file_no")
        .sortWithinPartitions("file_no", "doc_id", "n_tokens", "body")
        .mapInArrow(blocks, BLOCKS)
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a token folder: doc_id, start, n_tokens, ids_crc32, and the ids."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row an id of the vocabulary
    stride = spark.read.parquet(f"{path}/format").first()["stride"]
    code = Code(np.array([r["id"] for r in book], np.int64), np.array([r["length"] for r in book], np.int64))
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def make():
        symbol, length = code.reader()

        def step(batch: pa.RecordBatch):
            for row in batch.to_pylist():
                n = np.array(row["doc_tokens"], np.int64)
                stretches = -(-n // stride)
                counts = np.full(int(stretches.sum()), stride, np.int64)
                counts[np.cumsum(stretches) - 1] = n - (stretches - 1) * stride
                begins = np.array(row["checkpoints"], np.int64)
                payload = np.frombuffer(row["payload"], np.uint8)
                ids = huffman_decode(payload, begins, counts, symbol, length, code.width).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n)])
                bodies = [ids[ends[k] : ends[k + 1]] for k in range(len(n))]
                columns = [
                    pa.array(np.full(len(n), row["file_no"], np.int32)),
                    pa.array(np.full(len(n), row["block_no"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1]), pa.array(n),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                ]
                names = ["file_no", "block_no", "doc_id", "_within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([b.tolist() for b in bodies], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

        return step

    docs = arrow_map(
        stored, make,
        "file_no int, block_no int, doc_id long, _within long, n_tokens long, ids_crc32 long"
        + (", ids array<long>" if with_ids else ""),
    )
    sizes = stored.select("file_no", "block_no", "n_tokens")
    files = sizes.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))  # one row a file
    files = files.select(
        "file_no", F.coalesce(F.sum("_n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_file"),
    )
    inside = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "file_no", "block_no", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_block")
    ).join(files, "file_no")
    return docs.join(starts, ["file_no", "block_no"]).select(
        "doc_id", (F.col("_file") + F.col("_block") + F.col("_within")).alias("start"),
        "n_tokens", "ids_crc32", *(["ids"] if with_ids else []),
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes a token folder in the shared folder and reads it back, without the ids."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path, with_ids=False)


__all__ = ["Code", "code_lengths", "read_token_files", "round_trip", "write_token_files"]
