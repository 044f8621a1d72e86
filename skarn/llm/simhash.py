"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: a bit is set if it is set in over half of the hashes (XXH64, seed 42)
of a document's shingles, repeats included. Fingerprints link at ``radius`` (2) or fewer
differing bits, and components of links are groups of near-duplicates.

All links are found exactly. Equal fingerprints are merged first. The others are dealt to
tiles: fingerprints that differ in at most two bits agree in at least two of their four blocks of
16 bits, so one of six pairs of blocks is equal; a tile holds the fingerprints that agree in
such a pair and lie in a band of neighbouring population counts. Each fingerprint also visits the
band above when its count is so near that a link could reach there. Tiles whose population counts
differ beyond the radius never meet. Within a tile, numpy compares blocks by exclusive-or and bit counts.
A tile gives the edges of a spanning forest, not all its pairs.

Null and empty texts, and texts without words, have the fingerprint zero, which links like any
other. Repeated rows give repeated rows; a null doc_id is kept and never names a component unless
all of it is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, written
from skarn.operators.components import connected_components, spread_join

BLOCK = 1024  # fingerprints to a side of a comparison
REFINED = 1 << 14  # fingerprints of a tile beyond which it is cut into finer ones


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[min(shingle_words, len(words)) - 1 :] - 1
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)],
        dtype="<u8",
    )
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits, signed)."""

    def make():
        def step(batch: pa.RecordBatch):
            found = np.array(
                [fingerprint(t, shingle_words, seed) for t in batch.column(1).to_pylist()], np.uint64
            )
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges, the least node of each node's component."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        np.minimum.at(label, before[left], least)
        np.minimum.at(label, before[right], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def tile_rows(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile, whether as a visitor, and fingerprint: twelve rows a fingerprint at most."""
    blocks = [(fps >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    ones = np.bitwise_count(fps).astype(np.uint64)
    band = ones // np.uint64(radius + 1)
    # the count may reach the next band within the radius, never the one after it
    visits = (ones + np.uint64(radius)) // np.uint64(radius + 1) > band
    tiles, visitor, out = [], [], []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        key = (np.uint64(k) << np.uint64(38)) | (blocks[i] << np.uint64(22)) | (blocks[j] << np.uint64(6))
        tiles += [key | band, (key | (band + np.uint64(1)))[visits]]
        visitor += [np.zeros(len(fps), bool), np.ones(int(visits.sum()), bool)]
        out += [fps, fps[visits]]
    return np.concatenate(tiles), np.concatenate(visitor), np.concatenate(out)


def finer_tiles(fps: np.ndarray, visitor: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a large tile, by the same rule on quarters of its blocks.

    Two fingerprints that differ in two bits at most are equal in 6 of 8 bytes at least; of the tile's they are told
    apart by the bytes that vary, of which all but two are equal. So each choice of two bytes to leave out is a
    sorting by the others, and only rows that agree there are compared: at most 65,536 distinct ones.
    """
    whole = fps.view(np.uint8).reshape(len(fps), 8)
    varying = [k for k in range(8) if (whole[:, k] != whole[0, k]).any()]
    left, right = [], []
    for out in combinations(varying, min(2, len(varying))):
        mask = np.uint64((1 << 64) - 1 - sum(255 << (8 * k) for k in out))
        key = fps & mask
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            if b - a > 1:
                some = order[a:b]
                for found, into in zip(tile_edges(fps[some], visitor[some], radius, len(some)), (left, right), strict=True):
                    into.append(found)
    none = [np.empty(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def tile_edges(fps: np.ndarray, visitor: np.ndarray, radius: int, most: int = REFINED) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one tile; visitors meet their own kind elsewhere."""
    if len(fps) > most:
        return finer_tiles(fps, visitor, radius)
    order = np.lexsort((np.bitwise_count(fps), visitor))
    fps, visitor = fps[order], visitor[order]
    ones = np.bitwise_count(fps).astype(np.int64)
    home = int((~visitor).sum())
    label = np.arange(len(fps))
    for a in range(0, home, BLOCK):
        rows = slice(a, min(a + BLOCK, home))
        for b in range(a, len(fps), BLOCK):
            columns = slice(b, min(b + BLOCK, len(fps)))
            low, high = ones[columns].min(), ones[columns].max()
            if low > ones[rows].max() + radius or high < ones[rows].min() - radius:
                continue
            near = np.bitwise_count(fps[rows, None] ^ fps[None, columns]) <= radius
            i, j = np.nonzero(near)
            if len(i):
                label = forest(len(fps), np.concatenate([np.arange(len(fps)), i + a]), np.concatenate([label, j + b]))
    other = np.flatnonzero(label != np.arange(len(fps)))
    return fps[other], fps[label[other]]


def whole_tiles(all_batches):
    """Columns of batches that are sorted by the first one, cut between its values."""
    held: list[list[np.ndarray]] = []
    for batch in all_batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))  # the last tile may go on
        if held and held[0][0][0] != new[0][-1]:
            held.append([c[:cut] for c in new])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [[c[cut:] for c in new]]
        elif not held and cut:
            yield [c[:cut] for c in new]
            held = [[c[cut:] for c in new]]
        else:
            held.append(new)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``src``, ``dst`` whose components are those of all links among distinct ``fp``."""
    if radius > 2:
        raise ValueError("two of four blocks need not be equal beyond a radius of 2")

    def spread():
        def step(batch: pa.RecordBatch):
            tiles, visitor, fps = tile_rows(batch.column(0).to_numpy().view(np.uint64), radius)
            yield pa.record_batch(
                [pa.array(tiles.view(np.int64)), pa.array(visitor), pa.array(fps.view(np.int64))],
                names=["tile", "visitor", "fp"],
            )

        return step

    def compare(all_batches):
        def edges(tile: np.ndarray, visitor: np.ndarray, fp: np.ndarray):
            fp = fp.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            sizes = np.diff(np.append(first, len(tile)))
            left, right = [], []
            for start in first[sizes > 16]:
                end = start + int(sizes[np.searchsorted(first, start)])
                a, b = tile_edges(fp[start:end], visitor[start:end], radius)
                left.append(a)
                right.append(b)
            at = np.repeat(sizes <= 16, sizes).nonzero()[0]
            for lag in range(1, 16):  # the small tiles all at once
                at = at[at + lag < len(tile)]
                at = at[tile[at] == tile[at + lag]]
                if not len(at):
                    break
                near = np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius
                near &= ~(visitor[at] & visitor[at + lag])
                left.append(fp[at[near]])
                right.append(fp[at[near] + lag])
            if left:
                pair = [np.concatenate(x).view(np.int64) for x in (left, right)]
                if len(pair[0]):
                    yield pa.record_batch([pa.array(p) for p in pair], names=["src", "dst"])

        for tiles in whole_tiles(all_batches):
            yield from edges(*tiles)

    return (
        arrow_map(distinct.select("fp"), spread, "tile long, visitor boolean, fp long")
        .repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "src long, dst long")
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component)."""
    marked = written(fingerprints(docs, shingle_words), "fingerprints")
    n = marked.count()
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n"))
    groups = connected_components(fingerprint_links(distinct, radius))
    labelled = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"), F.col("_n").alias("_copies")
    )
    names = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n"))
    named = spread_join(labelled, names, "component", n).select("fp", "component_id", "_copies")
    return spread_join(marked, named, "fp", n, "_copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
