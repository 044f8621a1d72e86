import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skarn.llm import embedding_dups, nearest, similar, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp string, node int, places string, text_hash string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "Straße", " x"]
    base = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 150))) for _ in range(n)]
    near = []
    for t in base[: n // 3]:
        words = t.split(" ")
        words[draw.randrange(len(words))] = "CHANGED"
        near.append("\t ".join(words))
    texts = base + near + base[:5] + [None, "", " \n", "one", "one two", "ONE TWO"]
    return list(enumerate(texts))


def test_fingerprint_matches_its_definition():
    for _, t in corpus(1):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_match_brute_force(spark, seed):
    docs = corpus(seed)
    prints = {i: brute_fingerprint(t) for i, t in docs}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = groups(prints, edges)
    for r in simhash.near_duplicates(documents(spark, docs)).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == expected[r["doc_id"]]


def test_links_of_planted_fingerprints(spark):
    draw = random.Random(4)
    fps = set()
    for _ in range(40):
        base = draw.getrandbits(64)
        for _ in range(40):  # more than small tiles hold, all near each other
            flips = draw.sample(range(64), draw.randint(0, 3))
            fps.add(base ^ sum(1 << b for b in flips))
    fps |= {0, (1 << 64) - 1, 3, 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    from skarn.operators.components import connected_components

    got = {r["node"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
    order = sorted(fps)
    array = np.array(order, np.uint64)
    edges = [(order[i], order[j]) for i in range(len(order)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2) if j > i]
    parts = {}
    for n, top in groups(order, edges).items():
        parts.setdefault(top, set()).add(n)
    mine = {}
    for n in order:
        mine.setdefault(got.get(n, n), set()).add(n)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "only here without an id")]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == 4 and sorted(str(r["component_id"]) for r in found) == ["3", "3", "3", "None"]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_finer_tiles_give_the_same_components():
    draw = np.random.default_rng(3)
    fps = np.unique((np.uint64(7) << np.uint64(32)) | draw.integers(0, 1 << 11, 900).astype(np.uint64) << np.uint64(9))
    visitor = np.bitwise_count(fps) % 3 == 0

    def components(most):
        left, right = simhash.tile_edges(fps, visitor, 2, most)
        return groups(fps.tolist(), zip(left.tolist(), right.tolist(), strict=True))

    assert components(10) == components(10**6)


def test_whole_tiles_are_cut_between_their_values():
    import pyarrow as pa

    values = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 4, 11):
        parts = [pa.record_batch([pa.array(values[k : k + size])], names=["tile"]) for k in range(0, len(values), size)]
        tiles = [c[0].tolist() for c in simhash.whole_tiles(iter(parts))]
        assert sum(tiles, []) == values
        assert all(not set(a) & set(b) for a, b in zip(tiles, tiles[1:], strict=False))


def jaccard(a, b):
    def shingles(t):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return 1.0 if x == y else len(x & y) / len(x | y)


def similar_corpus(seed):
    draw = random.Random(seed)
    words = [f"k{k}" for k in range(5000)]
    base = [[draw.choice(words) for _ in range(draw.randint(150, 400))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base):  # from hardly changed to much changed copies
        for changes in (1, 3, 1 + k // 2, 5 + k):
            own = list(b)
            for _ in range(changes):
                own[draw.randrange(len(own))] = "CHANGED"
            texts.append(" \n".join(own))
    return list(enumerate([*texts, texts[0].upper(), None, "", "one two", "One TWO", "one three"]))


@pytest.mark.parametrize("part_rows", [similar.PART, 8])
def test_similar_groups_match_brute_force_but_for_the_estimate_s_error(spark, monkeypatch, part_rows):
    monkeypatch.setattr(similar, "PART", part_rows)
    monkeypatch.setattr(similar.links, "__defaults__", (part_rows,))
    docs = similar_corpus(6)
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(documents(spark, docs)).collect()}
    texts = dict(docs)
    pairs = [(a, b, jaccard(texts[a], texts[b])) for a in texts for b in texts if a < b]
    sure = groups(found, [(a, b) for a, b, j in pairs if j >= 0.85])
    most = groups(found, [(a, b) for a, b, j in pairs if j >= 0.7])
    for a, b, _ in pairs:
        if sure[a] == sure[b]:
            assert found[a] == found[b]
        if found[a] == found[b]:
            assert most[a] == most[b]
    near = [(a, b) for a, b, j in pairs if 0.8 <= j < 0.85]
    assert len(near) > 20 and np.mean([found[a] == found[b] for a, b in near]) > 0.85


@pytest.mark.parametrize("pairs", [1, similar.PAIRS])
def test_screened_groups_are_those_of_all_pairs_of_a_tile(monkeypatch, pairs):
    monkeypatch.setattr(similar, "PAIRS", pairs)
    monkeypatch.setattr(similar, "PART", 150)
    draw = np.random.default_rng(8)
    sizes = [200, 1, 150, 40, 2, 100, 3]  # the first is too large to be screened
    tile, node = np.repeat(np.arange(len(sizes)), sizes), draw.permutation(sum(sizes))
    base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    sig = base[draw.integers(0, 12, len(tile))]
    for _ in range(4):  # chains, in which the ends differ more than neighbours do
        sig = sig ^ (np.uint64(1) << draw.integers(0, 64, len(tile), dtype=np.uint64))
    label = list(range(len(tile)))
    for i in range(len(tile)):
        for j in range(i):
            if tile[i] == tile[j] and label[i] != label[j] and (tile[i] == 0 or (int(sig[i]) ^ int(sig[j])).bit_count() <= 5):
                label = [label[j] if x == label[i] else x for x in label]
    want = {tuple(sorted(node[k] for k in range(len(tile)) if label[k] == x)) for x in set(label)}
    group, member = similar.screened(tile, node, sig, 5)
    found = {}
    for g, m in zip(group, member, strict=True):
        found.setdefault(g, []).append(m)
    assert {tuple(sorted(x)) for x in found.values()} == {x for x in want if len(x) > 1}
    assert len(found) > 10


def test_a_tile_of_many_near_copies_is_screened_in_little_memory():
    rows = 4000  # eight million pairs
    tile, node, sig = np.zeros(rows, np.int64), np.arange(rows), np.zeros(rows, np.uint64)
    sig[::2] = 1
    tracemalloc.start()
    try:
        group, member = similar.screened(tile, node, sig, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(set(group.tolist())) == 1 and sorted(member.tolist()) == list(range(rows))
    assert peak < 48e6


def test_first_of_each_group_tells_rows_of_one_id_apart(spark):
    long = " ".join(f"q{k}" for k in range(120))
    rows = [
        (5, "first text here"), (5, "a wholly different second text"), (5, "first text here"), (7, "First\ttext HERE"),
        (None, long), (9, long + " end"), (None, "no id and no copy"), (None, None), (3, ""),
    ]
    kept = similar.first_of_each_group(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in kept.collect())) == sorted(
        [(5, "first text here"), (5, "a wholly different second text"), (9, long + " end"), (-1, "no id and no copy"), (3, "")]
    )
    assert similar.first_of_each_group(documents(spark, [])).count() == 0


def brute_removed(docs, window):
    words = {i: WORD.findall(t or "") for i, t in docs}
    seen = {}
    for w in words.values():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = {}
    for i, w in words.items():
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                covered[k : k + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[i] = (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed):
    draw = random.Random(seed)

    def prose(n):
        return [f"v{draw.randrange(3000)}" for _ in range(n)]

    shared = [prose(n) for n in (34, 35, 36, 55, 80, 120)]
    docs = []
    for k in range(40):
        body = prose(draw.randint(0, 60))
        for passage in draw.sample(shared, 2):
            cut = draw.randint(0, 8)
            body += passage[cut:] + prose(draw.randint(0, 30))
        docs.append((k, (" \n"[k % 2]).join(body)))
    own = prose(50)
    docs += [(100, "a " * 200), (101, " ".join(own + prose(3) + own)), (102, None), (103, ""), (104, " ".join(prose(35))), (105, docs[0][1]), (106, "ñ é " * 40)]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_substrings_match_brute_force(spark, seed):
    docs = passages(seed)
    expected = brute_removed(docs, 35)
    found = substring.remove_repeated(documents(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == expected and len(found) == len(docs)


def test_cover_holds_every_difference():
    for period, cover in ((substring.PERIOD, substring.COVER),):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeated_rows_null_ids_and_kept_text(spark):
    text = " ".join(f"u{k}" for k in range(50))
    docs = documents(spark, [(1, text), (1, text), (None, text + " tail"), (2, "short"), (1, "another text of one id")])
    found = substring.remove_repeated(docs, with_text=True, keep=("fp",)).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"], r["kept_text"], r["fp"]) for r in found) == sorted(
        [(1, 50, "", "x"), (1, 50, "", "x"), (-1, 50, "tail", "x"), (2, 0, "short", "x"), (1, 0, "another text of one id", "x")]
    )
    assert substring.remove_repeated(documents(spark, [])).count() == 0


def test_rows_without_an_id_do_not_share_places_by_a_short_hash(spark):
    """Two of many texts without a doc_id have the same 32-bit hash; only one of them repeats."""
    made = spark.range(400_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"{chr(97 + k)}"), F.col("id") * (k + 1)) for k in range(40)]).alias("text"))
    twins = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) = 2").orderBy("h").first()["t"]
    docs = [(None, twins[0]), (None, twins[1]), (1, "before " + twins[0]), (None, "other"), (2, twins[0] + " after")]
    found = substring.remove_repeated(documents(spark, docs), with_text=True).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 0, 40, 40, 40]
    assert {r["kept_text"] for r in found if not r["n_removed"]} == {twins[1], "other"}


def test_very_many_equal_rows_and_very_long_texts(spark):
    text = " ".join(f"u{k}" for k in range(60))
    once = " ".join(f"z{k}" for k in range(200_000))
    docs = documents(spark, [(None, text)] * 3000 + [(4, text)] * 3000 + [(8, once), (9, "pre " + text)])
    found = substring.remove_repeated(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["count"]) for r in found} == {(None, 60, 60, 3000), (4, 60, 60, 3000), (8, 200_000, 0, 1), (9, 61, 60, 1)}


def vectors(seed, n=300, size=24):
    draw = np.random.default_rng(seed)
    rows, label = [], 0
    base = draw.standard_normal((n, size))
    for k in range(n):
        rows.append((k, (base[k] * draw.uniform(0.1, 9)).tolist(), int(k % 3)))
    for k in range(n, n + 150):  # near and nearly near ones, in one hot label
        v = base[3 * (k % 20)] + draw.standard_normal(size) * draw.uniform(0, 0.4)
        rows.append((k, v.tolist(), label))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, (2 * np.array(rows[0][1])).tolist(), 0), (903, rows[0][1], 1), (904, rows[0][1], None)]
    rows += [(905, None, 0), (906, [], 0), (907, [0.0] * size, 0), (908, [float("nan")] + [1.0] * (size - 1), 0), (909, [None] + [1.0] * (size - 1), 0), (910, [float("inf")] * size, 0), (911, [1.0, 2.0], 0), (912, [2.0, 4.0], 0)]
    return rows


def comparable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_vector_links_match_brute_force(spark, cell_rows):
    rows = vectors(1)
    df = spark.createDataFrame([(*r, "n", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, node string, links double")
    links = {r[0]: set() for r in rows}
    good = [r for r in rows if comparable(r[1]) and r[2] is not None]
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12:
                    links[a[0]].add(b[0])
    expected = groups(sorted(links), [(a, b) for a, bs in links.items() for b in bs])
    found = embedding_dups.near_duplicate_vectors(df, cell_rows=cell_rows).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[r["vec_id"]]), expected[r["vec_id"]], expected[r["vec_id"]] == r["vec_id"]), r
    assert embedding_dups.near_duplicate_vectors(df.limit(0)).count() == 0


def test_nearest_match_brute_force(spark):
    rows = vectors(2, n=200)
    rows += [(1000, rows[5][1], 1), (1100, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, size int")
    found = nearest.nearest(df, df.where("vec_id % 100 = 0"), query_rows=2, candidate_rows=50).collect()
    good = [r for r in rows if comparable(r[1])]
    for q in (r for r in good if r[0] % 100 == 0):
        near = sorted((float(np.linalg.norm(np.array(q[1]) - np.array(c[1]))), c[0]) for c in good if c[0] != q[0] and len(c[1]) == len(q[1]))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q[0])
        assert [x[1] for x in own] == [i for _, i in near] and np.allclose([x[2] for x in own], [d for d, _ in near], rtol=1e-12)
    few = df.where("vec_id < 3")  # and so are vectors whose squares leave the range of doubles
    for power in (540, -540, 1000):
        far = df.where("embedding is not null and forall(embedding, x -> x is not null)").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2.0**power)))
        scaled = nearest.nearest(far, far.where("vec_id % 100 = 0"), candidate_rows=50).collect()
        by_rank = {(r["query_id"], r["rank"]): r for r in found if r["query_id"] < 1000}
        for r in scaled:
            if (r["query_id"], r["rank"]) in by_rank:
                near = by_rank[r["query_id"], r["rank"]]
                assert r["vec_id"] == near["vec_id"] and np.isclose(r["score"] * 2.0**-power, near["score"], rtol=1e-12)
        assert len(scaled) >= len(by_rank) > 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3000)] + [(5000, [1.0, 2.5])], "vec_id long, embedding array<double>")
    ties = nearest.nearest(same, same.where("vec_id in (0, 5000)"), candidate_rows=700).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in ties} == {(q, k + 1, v + k) for q, v in ((0, 1), (5000, 0)) for k in range(10)}
    assert nearest.nearest(few, few.where("vec_id = 0")).count() == 2
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_fingerprints_of_very_long_texts_and_of_very_many_rows_without_an_id(spark):
    draw = random.Random(9)
    long = " ".join(f"w{draw.randrange(5000)}" for _ in range(60_000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)
    rows = [(None, "a copy of many")] * 3000 + [(7, "a copy of many")] * 2000 + [(9, long), (None, long + " end")]
    found = simhash.near_duplicates(documents(spark, rows)).groupBy("doc_id", "fingerprint", "component_id").count().collect()
    assert sum(r["count"] for r in found) == len(rows)
    assert {r["component_id"] for r in found if r["fingerprint"] == f"{brute_fingerprint('a copy of many'):016x}"} == {7}
    kept = similar.first_of_each_group(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [7, 9]
