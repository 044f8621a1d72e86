import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skarn.llm import bpe, packing, token_counts, token_files
from skarn.llm.encoding import NOT_SURE, BulkEncoder, bulk_encoder, character_classes, tokenizer_path, word_starts

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "\n\n", "a<|endoftext|>b", "don't 'tis 'S 'll'll x' 's", "  x  \n\n\ty ", "日本語 テキスト", "हिन्दी ꟍ", "ñÑ 😀👍🏽", "a" * 5000,
    "\x00\x1c\x85　x", "1234 12a b3", "!!!...", "x\r\ny z",
]
SCHEMA = "doc_id long, text string, lang string, places int, bucket string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", 1, "b") for k, t in enumerate(texts)], SCHEMA)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make", [BulkEncoder, bpe.BacktrackingEncoder])
def test_ids_are_the_library_s(make):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("strevmld''  \n\t!1ñ é") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    encoder = make(PATH, cache_words=500)
    for k in range(0, len(texts), 700):
        part = texts[k : k + 700]
        ids, offsets = encoder.encode(part)
        for j, t in enumerate(part):
            assert ids[offsets[j] : offsets[j + 1]].tolist() == ids_of(t), t


def test_long_texts_in_parts_give_the_same_ids():
    draw = random.Random(8)
    encoder = BulkEncoder(PATH, part_chars=50)
    texts = ["".join(draw.choice("ab  \n\t'sé.1") for _ in range(draw.randint(0, 600))) for _ in range(200)]
    texts += ["x" * 400, " " * 300, "a b " * 200 + "ह" + " c d" * 50, "<|endoftext|> " * 40, None]
    ids, offsets = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(t), t


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_round_trips(text):
    encoder = bpe.backtracking_encoder(PATH)
    ids, _ = encoder.encode([text])
    assert ids.tolist() == ids_of(text)
    assert encoder.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


def test_sure_code_points_are_classed_as_the_library_does():
    classes = character_classes()
    sure = [chr(c) for c in np.flatnonzero(classes != NOT_SURE)]
    pre = LIBRARY.pre_tokenizer
    for before, after in (("a", "a"), ("1", "1"), ("!", "!"), ("\t", "\t"), (" ", "x")):
        joined = "\x02".join(before + c + after for c in sure)
        expected = [a for _, (a, _) in pre.pre_tokenize_str(joined)]
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        assert word_starts(codes, classes[codes], np.array([0])).tolist() == expected


def test_word_starts_follow_the_pattern():
    from skarn.llm.encoding import PRETOKEN

    draw, classes = random.Random(9), character_classes()
    for _ in range(2000):
        text = "".join(draw.choice("stremlvd''  \n1!a") for _ in range(draw.randint(1, 25)))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert word_starts(codes, classes[codes], np.array([0])).tolist() == [m.start() for m in regex.finditer(PRETOKEN, text)], text


def test_bpe_query_rows(spark):
    rows = {r["doc_id"]: r for r in bpe.encode_and_decode(documents(spark, ODD), with_content=True).collect()}
    assert len(rows) == len(ODD)
    for k, t in enumerate(ODD):
        ids = np.array(ids_of(t), "<u4")
        assert rows[k]["n_tokens"] == len(ids) and rows[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[k]["decoded"] == (t or "") and rows[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_and_decode(documents(spark, [])).count() == 0


def brute_sections(text, rule):
    text = text or ""
    ends = [k + 1 for k, c in enumerate(text) if c == "\n"]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    byte_ends = [len(text[:e].encode()) for e in ends]
    counts, at = [0.0] * len(ends), 0
    encoder = bpe.backtracking_encoder(PATH)
    for i in ids_of(text):
        start, at = at, at + int(encoder.token_sizes[i])
        overlap = [max(0, min(at, e) - max(start, b)) for b, e in zip([0, *byte_ends[:-1]], byte_ends, strict=True)]
        if rule == "share":
            counts = [c + o / (at - start) for c, o in zip(counts, overlap, strict=True)]
        else:
            counts[next(k for k, o in enumerate(overlap) if o) if rule == "first" else overlap.index(max(overlap))] += 1
    return list(zip([0, *ends[:-1]], ends, [round(c, 9) for c in counts], strict=True))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_token_counts(spark, rule):
    texts = [*ODD, "a\nb\n\n\n\nc", "x\n", "\n", "é\n\n  \n日本\n語"]
    found = token_counts.section_token_counts(documents(spark, texts), rule=rule).collect()
    for k, t in enumerate(texts):
        own = sorted((r["section"], r["start_char"], r["end_char"], round(r["n_tokens"], 9)) for r in found if r["doc_id"] == k)
        assert [x[1:] for x in own] == brute_sections(t, rule) and [x[0] for x in own] == list(range(len(own)))
    assert token_counts.section_token_counts(documents(spark, [])).count() == 0


@pytest.mark.parametrize("rule", ["first", "most", "share"])
def test_field_token_counts(spark, rule):
    rows = [("x", "one two\x1e three\n\n", None, "é日本"), (None, "", "", ""), ("y", None, "\n \n", "don\x1et"), ("y", "a" * 3000, " b", "")]
    df = spark.createDataFrame(rows, "k string, a string, b string, c string")
    found = token_counts.field_token_counts(df, "k", ["a", "b", "c"], rule=rule).collect()
    assert len(found) == 3 * len(rows) and {r["doc_id"] for r in found} == {"x", "y", None}
    whole = sum(len(ids_of("".join((f or "") + "\n" for f in r[1:]))) for r in rows)
    assert sum(r["n_tokens"] for r in found) == pytest.approx(whole)
    # a token belongs to the field that holds its first byte
    if rule == "first":
        text = "".join((f or "") + "\n" for f in rows[0][1:])
        ends = np.cumsum([len(((f or "") + "\n").encode()) for f in rows[0][1:]])
        sizes = [len(b) for b in token_bytes(ids_of(text))]
        begins = np.cumsum(sizes) - sizes
        expected = np.bincount(np.searchsorted(ends, begins, side="right"), minlength=3).tolist()
        assert [r["n_tokens"] for f in "abc" for r in found if r["doc_id"] == "x" and r["field"] == f] == expected


def token_bytes(ids):
    encoder = bpe.backtracking_encoder(PATH)
    return [bytes(encoder.token_pool[encoder.token_starts[i] : encoder.token_starts[i] + encoder.token_sizes[i]]) for i in ids]


def test_code_lengths_are_optimal_and_limited():
    draw = np.random.default_rng(0)
    for n, limit in ((3, 18), (50, 18), (300, 9)):
        counts = draw.zipf(1.3, n).clip(max=10**6)
        lengths = token_files.code_lengths(counts, limit)
        assert (2.0 ** -lengths).sum() <= 1 + 1e-12 and lengths.max() <= max(limit, np.ceil(np.log2(n)))
    free = token_files.code_lengths(np.array([1, 1, 2, 4]), 18)
    assert free.tolist() == [3, 3, 2, 1]
    limited = token_files.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3)
    assert limited.max() == 3
    assert token_files.code_lengths(np.array([0, 5, 0]), 18).tolist() == [0, 1, 0]


@given(st.lists(st.integers(0, 400), max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, stride):
    ids = np.array(ids, np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=401))
    used = np.flatnonzero(lengths)
    code = token_files.Code(used, lengths[used])
    cut = len(ids) // 3
    offsets = np.array([0, cut, len(ids)])
    data, starts, marks = token_files.huffman_encode(ids, offsets, *code.writer(), stride)
    counts, begins = [], []
    for k in range(2):
        n = int(offsets[k + 1] - offsets[k])
        counts += [min(stride, n - a) for a in range(0, n, stride)]
        begins += [int(m) + 8 * int(starts[k]) for m in marks[k]]
    got = token_files.huffman_decode(data, np.array(begins, np.int64), np.array(counts, np.int64), *code.reader(), code.width)
    assert got.tolist() == ids.tolist()


def test_token_files_round_trip(spark, tmp_path):
    texts = [*ODD, "z y x " * 400]
    docs = documents(spark, texts, 5).orderBy("text").unionByName(documents(spark, ["again", "again"], 7))
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, stride=16, block_tokens=64, file_tokens=500)
    found = token_files.read_token_files(spark, path).collect()
    files = spark.read.parquet(f"{path}/blocks").groupBy("file_no").agg({"n_tokens": "sum"}).count()
    assert files > 1
    expected = sorted((5 + k, ids_of(t) + [2]) for k, t in enumerate(texts)) + [(7, ids_of("again") + [2]), (8, ids_of("again") + [2])]
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted(expected)
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert token_files.round_trip(documents(spark, [])).count() == 0


def check_packing(rows, docs, size):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, text in docs:
        own = np.array(ids_of(text) + [2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own) and (len(own) > size or len(by_doc[doc_id]) == 1)
    return len(by_sequence)


def test_packing(spark):
    draw = random.Random(2)
    texts = [*ODD, "w " * 3000, *(" ".join(["word"] * draw.randint(1, 90)) for _ in range(120)), *["same text"] * 30]
    docs = documents(spark, texts)
    rows = packing.pack(docs, size=64, group_rows=10).collect()
    n = check_packing(rows, list(enumerate(texts)), 64)
    total = sum(len(ids_of(t)) + 1 for t in texts)
    assert n <= -(-total // 64) * 1.05 + 2
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "skewed", "few"])
def test_plan_holds_the_histogram_and_is_near_the_bound(kind):
    draw = np.random.default_rng(1)
    lengths = {"uniform": draw.integers(1, 128, 6000), "skewed": np.clip(draw.lognormal(3, 0.8, 6000).astype(int), 1, 128), "few": draw.choice([40, 50, 65, 90], 900)}[kind]
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    held = {}
    plan = packing.plan_columns(histogram, 128)
    for column, count in plan:
        assert sum(x * n for x, n in column) <= 128
        for x, n in column:
            held[x] = held.get(x, 0) + n * count
    assert held == histogram
    n = sum(c for _, c in plan)
    greedy = len(packing.best_fit(histogram, 128))
    _, bound = packing.fractional_columns({x: c for x, c in histogram.items() if x < 128}, 128, 50, 0.5)
    assert bound - 1e-6 <= n <= greedy * 1.01 + 1


def test_bulk_encoder_is_shared():
    assert bulk_encoder(PATH) is bulk_encoder(PATH)


def fewest_sequences(lengths, size):
    """The least number of sequences, by trying all ways to fill one with the longest piece left."""
    from functools import lru_cache

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        ways = {rest}

        def fill(room, at, kept):
            ways.add(tuple(kept) + rest[at:])
            for k in range(at, len(rest)):
                if rest[k] <= room:
                    fill(room - rest[k], k + 1, [*kept, *rest[at:k]])
                    fill(room, k + 1, [*kept, *rest[at : k + 1]])
                    return

        fill(size - first, 0, [])
        return 1 + min(least(w) for w in ways if len(w) < len(left))

    return least(tuple(sorted(lengths, reverse=True)))


@pytest.mark.parametrize("seed", range(12))
def test_plans_against_the_exact_optimum_of_small_instances(seed):
    draw = random.Random(seed)
    size = 30
    lengths = [draw.randint(3, 20) for _ in range(draw.randint(1, 11))]
    plan = packing.plan_columns({x: lengths.count(x) for x in set(lengths)}, size)
    assert sorted(x for column, n in plan for x, t in column for _ in range(n * t)) == sorted(lengths)
    assert all(sum(x * t for x, t in column) <= size for column, _ in plan)
    least = fewest_sequences(lengths, size)
    assert least <= sum(n for _, n in plan) <= least + (1 if least > 2 else 0)


def test_packing_of_very_many_equal_rows(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000 + [(1, "x " * 5000)] * 2, "doc_id long, text string")
    rows = packing.pack(docs, group_rows=500).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["doc_id"] is None for r in rows) == 3000
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * (len(ids_of("x " * 5000)) + 1)


def test_rows_of_one_id_are_dealt_to_neighbouring_files(spark, tmp_path):
    texts = [(None, f"a b c {k % 7}") for k in range(900)] + [(5, "same text")] * 900 + [(k, "other " * (k % 9)) for k in range(10, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, file_tokens=400, block_tokens=100)
    held = spark.read.parquet(f"{path}/blocks").selectExpr("file_no", "n_tokens").groupBy("file_no").sum("n_tokens").collect()
    assert len(held) > 5 and max(r[1] for r in held) < 0.5 * sum(r[1] for r in held)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in rows] == sorted((i or -1) for i, _ in texts)
    assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
    got, own = sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in rows), sorted((i or -1, (*ids_of(t), 2)) for i, t in texts)
    assert got == own


def test_file_numbers_ascend_with_ids():
    draw = np.random.default_rng(1)
    for _ in range(50):
        ids = np.sort(draw.integers(-5, 6, 200))
        cuts = np.sort(draw.integers(-5, 6, 7))
        numbers = token_files.file_numbers(cuts, ids)
        for i in np.unique(ids):
            own = numbers[ids == i]
            assert numbers[ids < i].max(initial=0) <= own.min() and own.max() <= numbers[ids > i].min(initial=7)


def test_very_long_texts_are_read_whole(spark, tmp_path):
    draw = random.Random(2)
    text = "".join(draw.choice(["alpha ", "beta\n", "ünï ", "12 ", "  "]) for _ in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (None, text[:50_000])], "doc_id long, text string")
    sections = token_counts.section_token_counts(docs).collect()
    own = [r for r in sections if r["doc_id"] == 1]
    assert sum(r["n_tokens"] for r in own) == len(ids_of(text)) and max(r["end_char"] for r in own) == len(text) and len(own) == text.count("\n") + (not text.endswith("\n"))
    path = f"file://{tmp_path}/long"
    token_files.write_token_files(docs, path, block_tokens=1000)
    found = {r["n_tokens"]: r["ids"] for r in token_files.read_token_files(spark, path).collect()}
    assert found[len(ids_of(text)) + 1] == [*ids_of(text), 2] and len(found) == 3
