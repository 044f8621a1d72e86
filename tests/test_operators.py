import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn.operators import assignment, blocking, features, joins, multisets, selection, trees
from skarn.operators.components import connected_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unique_key_join_needs_one_on_either_side(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "l long, k string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "r long, k string")
    assert rows(joins.unique_key_join(left, right, "k")) == [("a", 1, 1)]


def test_band_join_matches_brute_force(spark):
    draw = random.Random(3)
    a = [(k, draw.choice("xy"), draw.randint(-500, 500)) for k in range(60)]
    b = [(k, draw.choice("xy"), draw.randint(-500, 500)) for k in range(60)]
    found = joins.band_join(
        spark.createDataFrame(a, "l long, k string, lt long"), spark.createDataFrame(b, "r long, k string, rt long"), ["k"], "lt", "rt", 40
    ).select("l", "r")
    assert rows(found) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 40)


def test_greedy_link_goes_in_order_and_uses_up_targets(spark):
    schema = "k string, id string, at double, ord string"
    left = spark.createDataFrame([("x", "p1", 0.0, "1"), ("x", "p2", 10.0, "2"), ("x", "p3", 9000.0, "3")], schema)
    right = spark.createDataFrame([("x", "n1", 100.0, "1"), ("x", "n2", 131.0, "2")], schema)
    # p1 sees n1 only; then p2 sees n2 only, as n1 is used
    assert rows(joins.greedy_band_link(left, right, ["k"], "at", "ord", 121)) == [("p1", "n1"), ("p2", "n2")]


def test_compare_full(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k long") for v in ([1, 2, 2], [2, 3]))
    assert rows(joins.compare_full(a, b, ["k"])) == [(1, "left_only"), (2, "both"), (3, "right_only")]


def test_latest_top_runs_margin(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, "w")], "k string, t long, v string")
    assert rows(selection.latest_per_key(df, ["k"], [F.col("t"), F.col("v")])) == [("a", 3, "z", 2), ("b", 2, "w", 0)]
    assert rows(selection.top_k(df, ["k"], [F.col("t").desc(), F.col("v")], 1).select("k", "v")) == [("a", "y"), ("b", "w")]
    runs = spark.createDataFrame([(1, 1, "u"), (1, 2, "u"), (1, 3, None), (1, 4, None), (1, 5, "u")], "c long, t long, r string")
    assert [r["run"] for r in selection.runs(runs, ["c"], ["t"], "r").orderBy("t").collect()] == [0, 0, 1, 1, 2]
    scored = spark.createDataFrame([("p", "a", 0.9), ("p", "b", 0.7), ("q", "a", 0.5)], "p string, n string, s double")
    found = {(r["p"], r["n"]): round(r["margin"], 6) for r in selection.runner_up_margin(scored, "p", "s", "n").collect()}
    assert found == {("p", "a"): 0.2, ("p", "b"): 0.0, ("q", "a"): 1.0}


@pytest.mark.parametrize("values", [[1], [1, 2], [5, 5, 1, 9], [3, 1, 2, 2, 8]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v long")
    assert selection.exact_median(df, ["k"], "v").first()["median"] == float(np.median(values))


def test_import_window_needs_coverage(spark):
    day = 86400
    near = spark.createDataFrame([("k", t * day) for t in (0, 1, 2, 100)], "k string, at long")
    assert tuple(selection.import_window(near, ["k"], "at").first()) == ("k", 4, 3, 0, 2 * day)
    far = spark.createDataFrame([("k", t * day) for t in (0, 100, 200, 300)], "k string, at long")
    assert selection.import_window(far, ["k"], "at").first()["window_start"] is None


def test_tree_paths_cycles_and_unknown_parents(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z")], "id string, parent_id string, title string")
    assert rows(trees.tree_paths(nodes).select("id", F.array_join("path", "/"))) == [("a", "A"), ("b", "A/B"), ("c", "A/B/C"), ("x", "/".join("YX" * 50)), ("y", "/".join("XY" * 50)), ("z", "Z")]
    assert rows(trees.subtree(nodes, spark.createDataFrame([("a",), ("x",)], "id string"), depth=5)) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]
    paths = spark.createDataFrame([(["r", "s"],), (["r", "t"],)], "path array<string>")
    assert rows(trees.path_prefixes(paths).select("level", "title")) == [(0, "r"), (1, "s"), (1, "t")]


def test_multiset_diff(spark):
    a, b = (spark.createDataFrame([(1, x) for x in v], "p long, i string") for v in ("aab", "abbc"))
    found = multisets.multiset_diff(a, b, ["p"], ["i"])
    assert rows(found) == [(1, "a", 1, 0, 1), (1, "b", 0, 1, 1), (1, "c", 0, 1, 0)]
    assert rows(multisets.describe_counts(found, ["p"], "i", "n_added", "t")) == [(1, "b:1, c:1")]


@pytest.mark.parametrize("seed", range(3))
def test_components_match_brute_force(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(None, 3), (5, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    expected = sorted((x, top(x)) for x in list(parent))
    assert rows(connected_components(spark.createDataFrame(edges, "src long, dst long"))) == expected


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([], "src long, dst long"))) == []


def best_total(edges, baseline):
    sources = sorted({s for s, _, _ in edges})
    best = 0.0
    options = [[None, *[(x, v) for s2, x, v in edges if s2 == s]] for s in sources]
    for choice in itertools.product(*options):
        used = [c[0] for c in choice if c]
        if len(used) == len(set(used)):
            best = max(best, sum(c[1] - baseline for c in choice if c))
    return best


def test_assignment_matches_brute_force():
    draw = random.Random(42)
    for _ in range(60):
        p, t = draw.randint(1, 4), draw.randint(1, 4)
        edges = [(f"s{i}", f"t{j}", draw.uniform(0.3, 1.0)) for i in range(p) for j in range(t) if draw.random() < 0.7]
        if edges:
            taken = assignment.assign_component(pd.DataFrame(edges, columns=["source_id", "target_id", "score"]), 0.45)
            assert taken["source_id"].is_unique and taken["target_id"].is_unique
            assert abs((taken["score"] - 0.45).sum() - best_total(edges, 0.45)) < 1e-6


def test_sparse_assignment_of_a_large_component_matches_the_dense_solution():
    import time

    draw = random.Random(7)
    edges = pd.DataFrame([(f"s{i}", f"t{(i + d) % 4000}", draw.uniform(0.3, 1.0)) for i in range(4000) for d in (0, 1, 2, 5)], columns=["source_id", "target_id", "score"])
    began = time.time()
    taken = assignment.assign_component(edges, 0.45)
    assert time.time() - began < 60 and taken["source_id"].is_unique and taken["target_id"].is_unique
    few = edges[edges["source_id"].isin([f"s{i}" for i in range(60)])]
    total = assignment.assign_component(few, 0.45)["score"].sub(0.45).sum()
    # the best total by relaxation: no set of prices may promise less
    import numpy as np

    sources, targets = sorted(few["source_id"].unique()), sorted(few["target_id"].unique())
    size = len(sources) + len(targets)
    gain = np.zeros((size, size))
    for s, t, v in few.itertuples(index=False):
        gain[sources.index(s), targets.index(t)] = max(0.0, v - 0.45)
    prices, rows_of = np.zeros(size), {}
    step, free = 1e-5, list(range(size))  # an auction, exact to size times its step
    while free:
        i = free.pop()
        value = gain[i] - prices
        j = int(value.argmax())
        first = value[j]
        value[j] = -np.inf
        prices[j] += first - value.max() + step
        if j in rows_of:
            free.append(rows_of[j])
        rows_of[j] = i
    assert abs(total - sum(gain[i, j] for j, i in rows_of.items())) < size * step


def test_assign_by_component(spark):
    edges = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.8), ("b", "y", 0.7), ("c", "z", 0.2)], "source_id string, target_id string, score double")
    assert rows(assignment.assign(edges).select("source_id", "target_id")) == [("a", "x"), ("b", "y")]


def test_candidates_keep_the_wanted_among_many(spark):
    source = spark.createDataFrame([("p", "title", "T"), ("p", "line", "L"), ("q", "token", "w"), ("q", "title", "none")], "p string, kind string, key string")
    target = [("n0", "title", "T"), ("n0", "line", "L")] + [(f"m{k:03}", "title", "T") for k in range(150)] + [("n1", "token", "w"), ("n2", "token", "T")]
    found = blocking.candidates(source, spark.createDataFrame(target, "n string, kind string, key string"), "p", "n")
    per = {r["p"]: r["count"] for r in found.groupBy("p").count().collect()}
    assert per == {"p": 100, "q": 1}
    assert ("p", "n0", 18) in rows(found) and ("q", "n1", 3) in rows(found)


def test_a_moved_note_that_shares_a_line_stays_among_many_of_the_section(spark):
    """150 distractors of the same section rank 5, the line's note 8."""
    source = spark.createDataFrame([("p", "section", "S"), ("p", "line", "L")], "p string, kind string, key string")
    target = [("z-moved", "line", "L"), ("z-moved", "section", "Other")] + [(f"m{k:03}", "section", "S") for k in range(150)]
    for hot in (10, 1000):
        found = blocking.candidates(source, spark.createDataFrame(target, "n string, kind string, key string"), "p", "n", hot=hot)
        assert ("p", "z-moved", 8.0) in rows(found) and found.count() == 100 and ("p", "m000", 5.0) in rows(found)


def test_very_many_hot_keys_of_a_record_are_not_multiplied(spark):
    """Three kinds with 120 hot keys each have 1.7 million combinations; the lines of one template are one key."""
    kinds = ("line", "resource", "url")
    source = [("p", kind, f"{kind}{j}") for kind in kinds for j in range(120)] + [("p", "title", "T")]
    target = [(f"t{k:02}", kind, f"{kind}{j}") for k in range(30) for kind in kinds for j in range(120)]
    target += [(f"u{k:02}", "line", f"line{j}") for k in range(30) for j in range(k, k + 60)] + [("v", "title", "T"), ("v", "line", "line1")]
    schema = "{} string, kind string, key string"
    found = blocking.candidates(spark.createDataFrame(source, schema.format("p")), spark.createDataFrame(target, schema.format("t")), "p", "t", k=40, hot=5)
    assert rows(found.orderBy(F.col("rank").desc(), "t")) == sorted([("p", "v", 18.0)] + [("p", f"t{k:02}", 16.0) for k in range(30)] + [("p", f"u{k:02}", 8.0) for k in range(9)])


def test_containment_finds_the_first_longer_text(spark):
    inner = "one two three four five six seven eight nine ten eleven"
    long_word = "w" * 60
    items = spark.createDataFrame([("a", inner), ("b", "short"), ("c", long_word), ("d", "not " + inner)], "i string, text string")
    docs = spark.createDataFrame([("y", "2", "x" + inner + "y"), ("z", "1", "intro " + inner), ("s", "0", inner), ("v", "3", "a" + long_word)], "d string, ord string, text string")
    assert rows(blocking.containment(items, docs, "i", "d", "ord")) == [("a", "z"), ("c", "v")]


def test_features(spark):
    df = spark.createDataFrame([(["n", "g", "s"], ["r", "n", "g", "s"], ["a", "b"], ["b", "c"], "abc", "abd", 0.0, 7 * 86400.0)], "p array<string>, q array<string>, a array<string>, b array<string>, s string, t string, x double, y double")
    c = F.col
    got = df.select(
        features.path_similarity(c("p"), c("q")), features.path_similarity(c("p"), c("p")), features.path_similarity(c("p"), F.array()), features.jaccard(c("a"), c("b")),
        features.string_ratio(c("s"), c("t")), features.time_similarity(c("x"), c("y")), features.time_similarity(c("x"), F.lit(None)), features.count_similarity((F.lit(0), F.lit(0)), (F.lit(1), F.lit(4))),
        features.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
    ).first()
    assert [None if v is None else round(v, 4) for v in got] == [0.8, 1.0, 0.0, 0.3333, 0.6667, 0.5, None, 0.25, None]
    score, n = features.weighted_score({"title": F.lit(1.0), "path": F.lit(None).cast("double"), "level": F.lit(0.9)})
    assert [round(v, 6) for v in df.select(score, n).first()] == [round((2 + 0.225) / 2.25, 6), 2]
    classes = [df.select(features.confidence(F.lit(s), F.lit(m))).first()[0] for s, m in ((0.9, 0.1), (0.7, 0.05), (0.9, 0.01))]
    assert classes == ["high-confidence", "probable", "ambiguous"]


def test_text_bound_is_never_exceeded(spark):
    draw = random.Random(1)
    pairs = [("".join(draw.choice("ab ") for _ in range(draw.randint(0, 30))), "".join(draw.choice("ab ") for _ in range(draw.randint(0, 30)))) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string").select(features.text_similarity(F.col("a"), F.col("b")).alias("s"), features.text_similarity_bound(F.col("a"), F.col("b")).alias("m"))
    assert all((r["s"] is None) == (r["m"] is None) and (r["s"] is None or r["s"] <= r["m"] + 1e-12) for r in df.collect())


def test_truncated_text_counts_by_its_share_of_the_shorter(spark):
    draw = random.Random(7)
    text = "".join(draw.choice("abcdefghij klmnop") for _ in range(2000))
    edited = text[:60] + "#" * 10 + text[70:180]

    def expected(a, b):
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        return max(2 * matched / (len(a) + len(b)), 0.95 * matched / min(len(a), len(b)))

    pairs = [(text, text[:600]), (text[:600], text), (text, edited), (edited, text), (text, text), (text, "?"), (text, text[900:1300])]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", features.text_similarity(F.col("a"), F.col("b")).alias("s"), features.text_similarity_bound(F.col("a"), F.col("b")).alias("m")).collect()
    by_pair = {(r["a"], r["b"]): r for r in got}
    for a, b in pairs:
        assert abs(by_pair[a, b]["s"] - expected(a, b)) < 1e-12 and by_pair[a, b]["s"] <= by_pair[a, b]["m"] + 1e-12
    assert abs(by_pair[text, text[:600]]["s"] - 0.95) < 1e-12 and by_pair[text, edited]["s"] > 0.8


@pytest.mark.parametrize("hot, most", [(0, 1), (4, 1), (1000, 1), (0, 3), (6, 3), (1000, 3)])
def test_candidates_match_brute_force_whatever_is_hot(spark, hot, most):
    draw = random.Random(hot + 5 * most)
    kinds = ["title", "section", "line", "url", "notebook"]

    def side(n, prefix):
        found = [(f"{prefix}{k:02}", kind, f"{kind}{draw.randrange(4)}") for k in range(n) for kind in kinds for _ in range(draw.randint(0, most))]
        return sorted({*found, *((f"{prefix}{k:02}", "token", f"w{draw.randrange(6)}") for k in range(n) for _ in range(draw.randint(0, 4)))})

    source, target = side(14, "s"), side(50, "t")
    expected = []
    for s in sorted({x[0] for x in source}):
        mine, per = {x[1:] for x in source if x[0] == s}, {}
        for t in {x[0] for x in target}:
            its = {x[1:] for x in target if x[0] == t}
            a, b = ({w for kind, w in x if kind == "token"} for x in (mine, its))
            shared = {kind for kind, _ in mine & its}
            weights = {"title": 10, "section": 5, "line": 8, "notebook": 2}
            rank = sum(weights.get(kind, 0) for kind in shared) + (3.0 * len(a & b) / len(a | b) if a and b else 0.0)
            per.setdefault(bool(shared - {"token", "notebook"}), []).append((rank, t)) if shared else None
        expected += [(s, t, round(r, 9)) for r, t in sorted(per.get(True) or per.get(False) or [], key=lambda x: (-x[0], x[1]))[:5]]
    schema = "{} string, kind string, key string"
    found = blocking.candidates(spark.createDataFrame(source, schema.format("s")), spark.createDataFrame(target, schema.format("t")), "s", "t", k=5, hot=hot)
    assert rows(found.select("s", "t", F.round("rank", 9))) == sorted(expected)


def test_path_similarity_folds_case_and_compares_last_parts(spark):
    cases = [
        (["Notebook", "Group", "Section"], ["Import", "Section"], 0.8), (["Notebook", "Group", "Section"], ["Section"], 0.8), (["N", "Straße"], ["n", "STRASSE"], 1.0),
        (["N", "S"], ["x", "s"], 0.8), (["Notebook", "S"], ["Import", "NOTEBOOK", "T"], 0.4), (["N", "S"], ["S", "T"], 0.0), (["N", "S"], [], 0.0),
    ]
    df = spark.createDataFrame([(k, *case) for k, case in enumerate(cases)], "k int, p array<string>, q array<string>, expected double")
    got = df.select("k", features.path_similarity(F.col("p"), F.col("q")).alias("s"), "expected").orderBy("k").collect()
    assert [r["s"] for r in got] == [r["expected"] for r in got]


def test_containment_finds_texts_of_one_or_two_words(spark):
    u, v, w = "https://one.example/abcdefghij", "https://two.example/klmnopqrst", "z" * 20 + "0123456789" * 4
    items = [("two", f"{u}\n{v}"), ("cut", f"{u[4:]} {v}0"), ("one", w), ("wide", "a" + " " * 50 + "b"), ("blank", " " * 52), ("none", f"{v} {u}")]
    docs = [("d1", "1", f"see {u}\n{v} for more"), ("d2", "2", f"x{u} {v}012 end"), ("d3", "3", f"q{w}q"), ("d4", "4", f"xa{' ' * 50}by"), ("d5", "5", "x" + " " * 60 + "y"), ("d6", "6", u), ("d7", "7", v)]
    first = {}
    for i, inner in items:
        found = [(o, d) for d, o, outer in docs if len(outer) > len(inner) and inner in outer]
        if found:
            first[i] = min(found)[1]
    got = blocking.containment(spark.createDataFrame(items, "i string, text string"), spark.createDataFrame(docs, "d string, ord string, text string"), "i", "d", "ord")
    assert dict(rows(got)) == first == {"two": "d1", "cut": "d2", "one": "d3", "wide": "d4", "blank": "d5"}


def test_paths_of_cycles_deep_chains_and_unknown_parents(spark):
    nodes = [("a", "b", "A"), ("b", "a", "B"), ("c", "a", "C"), ("r", None, "R"), ("e", "", "E"), ("u", "gone", "U")]
    nodes += [(f"n{k}", f"n{k - 1}" if k else "r", f"T{k}") for k in range(250)]
    found = {r["id"]: (r["path"], r["level"]) for r in trees.tree_paths(spark.createDataFrame(nodes, "id string, parent_id string, title string")).collect()}
    by_id = {i: (p, t) for i, p, t in nodes}
    for i, _, _ in nodes:
        chain, now = [], i
        while now and now in by_id and len(chain) < 100:
            chain.append(by_id[now][1])
            now = by_id[now][0]
        assert found[i] == (chain[::-1], len(chain) - 1)
    assert len(found) == len(nodes) and found["a"][0][-3:] == ["A", "B", "A"]
    assert trees.tree_paths(spark.createDataFrame([], "id string, parent_id string, title string")).count() == 0


def test_global_rank_with_a_hot_leading_key(spark):
    draw = random.Random(3)
    data = [("hot" if draw.random() < 0.8 else f"k{draw.randrange(9)}", draw.randrange(50), k) for k in range(3000)]
    ranked = selection.global_rank(spark.createDataFrame(data, "k string, v int, id int").repartition(7), [F.col("k"), F.col("v"), F.col("id")]).collect()
    assert [(r["k"], r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["place"])] == sorted(data)
    assert sorted(r["place"] for r in ranked) == list(range(1, 3001))


@pytest.mark.parametrize("seed", range(3))
def test_exact_medians_match_brute_force(spark, seed):
    import statistics

    draw = random.Random(seed)
    make = {"a": lambda: draw.randrange(10**9), "b": lambda: draw.choice([1, 2, 2, 2, 10**12]), "c": lambda: 5, "d": lambda: draw.randrange(4)}
    data = [(k, float(f()) if seed else f()) for k, f in make.items() for _ in range(draw.randint(1, 400))] + [("z", None), ("one", 7)]
    kind = "double" if seed else "long"
    data = [(k, None if v is None else (float(v) if seed else int(v))) for k, v in data]
    found = {r["k"]: (r["n"], r["median"]) for r in selection.exact_median(spark.createDataFrame(data, f"k string, v {kind}"), ["k"], "v").collect()}
    expected = {}
    for k in {k for k, v in data if v is not None}:
        own = [v for k2, v in data if k2 == k and v is not None]
        expected[k] = (len(own), float(statistics.median(own)))
    assert found == expected


@pytest.mark.parametrize("seed", range(4))
def test_greedy_links_match_the_rule_row_by_row(spark, seed):
    draw = random.Random(seed)
    spread = (50, 400, 3000, 20000)[seed]

    def side(n, prefix):
        return [(draw.choice("xy") if draw.random() < 0.95 else None, f"{prefix}{k}", float(draw.randrange(spread)) if draw.random() < 0.95 else None, f"{draw.randrange(10**6):06}") for k in range(n)]

    left, right = side(80, "l"), side(90, "r")
    expected, used = [], set()
    for k, i, at, _ in sorted(left, key=lambda r: (r[3], r[1])):
        near = [j for k2, j, at2, _ in right if k2 == k and k is not None and at is not None and at2 is not None and abs(at - at2) <= 120 and j not in used]
        if len(near) == 1:
            used.add(near[0])
            expected.append((i, near[0]))
    schema = "k string, id string, at double, ord string"
    found = joins.greedy_band_link(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "at", "ord", 120)
    assert rows(found.select("left_id", "right_id")) == sorted(expected)


def test_text_similarity_reads_whole_texts(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    begin, first, second = (" ".join(draw.choice(words) for _ in range(n)) for n in (1000, 900, 900))
    assert len(begin) > 5000

    def expected(a, b):
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        return max(2 * matched / (len(a) + len(b)), 0.95 * matched / min(len(a), len(b)))

    pairs = [(begin + first, begin + second), (begin + first, second), (first, begin + first), (begin, second), ("é😀" * 40 + first, first[50:] + "😀é")]
    for a, b in pairs:  # the same by difflib alone and by runs of equal characters
        assert features.shared_part(a, b) == expected(a, b)
        assert features.shared_part(a, b, 0.99) in (0.0, expected(a, b)) and features.shared_part(a, b, expected(a, b) - 0.01) == expected(a, b)
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", features.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r["s"] - expected(r["a"], r["b"])) < 1e-12 for r in got)


def test_matching_is_that_of_difflib(monkeypatch):
    draw = random.Random(6)
    for k in range(600):
        monkeypatch.setattr(features, "SEEDS", 40 if k % 4 == 0 else 1 << 22)
        letters = ("ab", "abcdefgh zé😀", "abcdefghijklmnopqrstuvwxyz   eeee")[k % 3]
        a, b = ("".join(draw.choice(letters) for _ in range(draw.randint(1, 400))) for _ in range(2))
        b = b if k % 2 else a[len(a) // 3 :] + a[: draw.randint(0, len(a))] + "q"
        assert features.Matching(a, b).size() == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_texts_in_others_meet_few(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghé ") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(8, 60))) for _ in range(120)]
    parts = [(t := texts[draw.randrange(120)])[(k := draw.randrange(len(t) // 2)) : k + draw.randint(45, 80)] for _ in range(60)] + texts[:20]
    items, docs = [(f"i{k}", t) for k, t in enumerate(parts)], [(k, f"o{k * 37 % 101:03}", t) for k, t in enumerate(texts + texts[:30])]
    expected = []
    for name, t in items:
        around = [(o, d) for d, o, x in docs if len(t) >= 50 and len(x) > len(t) and t in x]
        expected += [(name, min(around)[1])] if around else []
    given = spark.createDataFrame(items, "i string, text string"), spark.createDataFrame(docs, "d int, ord string, text string")
    assert len(expected) > 20 and sorted(tuple(r) for r in blocking.containment(*given, "i", "d", "ord").collect()) == sorted(expected)
    for inner, outer in ((b"x" * 60, b"y" * 50 + b"x" * 61), (b"ab" * 40, b"ab" * 50)):
        assert set(blocking.least_grams(inner, 50)) <= set(blocking.least_grams(outer, 50))


def test_pairs_meet_only_keys_that_both_sides_hold(spark):
    rows = [(f"s{k}", "line", f"own{k}-{j}") for k in range(3) for j in range(50)] + [(f"s{k}", "line", "both") for k in range(3)]
    source = spark.createDataFrame(rows, "s string, kind string, key string")
    target = source.select(F.replace("s", F.lit("s"), F.lit("t")).alias("t"), "kind", F.when(F.col("key") == "both", "both").otherwise(F.concat("key", F.lit("t"))).alias("key"))
    left, right = (df.select(name, "kind", F.xxhash64("kind", "key").alias("hash")) for df, name in ((source, "s"), (target, "t")))
    found = blocking.best_pairs(left, right, "s", "t", 100, 1000, ["line"])
    assert sorted(tuple(r) for r in found.collect()) == [(f"s{a}", f"t{b}", 8.0) for a in range(3) for b in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "struct(kind" not in plan


def test_pairs_below_the_baseline_link_no_components(spark, monkeypatch):
    seen = []
    whole = assignment.connected_components
    monkeypatch.setattr(assignment, "connected_components", lambda nodes: seen.append(nodes.count()) or whole(nodes))
    edges = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.3), ("b", "y", 0.8), ("b", "x", 0.45)], "source_id string, target_id string, score double")
    assert rows(assignment.assign(edges).select("source_id", "target_id")) == [("a", "x"), ("b", "y")] and seen == [2]
