import difflib
import json
import unicodedata
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from comparing import FOLDER, spark_rows, sql_rows

from skarn.normalize import html, markdown, model, render
from skarn.plans import catalogue

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


def rows_of(spark, name):
    return catalogue.queries()[name](spark, str(FOLDER)).collect()


def table(name):
    return pq.read_table(FOLDER / f"{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, str(FOLDER))) == sql_rows(catalogue.oracle_sql()[name])


def test_every_query_without_sql_has_a_test_here():
    tested = {
        "html_semantic", "html_links", "rendered_roundtrip", "markdown_semantic", "block_diff", "html_resources", "fuzzy_title", "fuzzy_text", "greedy_time_link",
        "global_assignment", "audit_flagship", "audit_findings",
    }
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == tested


def test_pages_against_their_trees_one_by_one(spark):
    trees = {r["page_id"]: html.parse(r["html"]) for r in table("pages")}
    found = {r["page_id"]: r for r in rows_of(spark, "html_semantic")}
    assert set(found) == set(trees) and any(r["n_blocks"] > 1 for r in found.values())
    for i, tree in trees.items():
        r, text = found[i], model.visible_text(tree)
        assert (r["semantic_sha256"], r["n_chars"], r["n_blocks"]) == (model.digest(tree), len(text), len(tree["children"]))
    links = {}
    for r in rows_of(spark, "html_links"):
        links.setdefault(r["page_id"], {})[r["place"]] = r["href"]
    assert {i: [own[k] for k in range(len(own))] for i, own in links.items()} == {i: model.links(t) for i, t in trees.items() if model.links(t)}
    for r in rows_of(spark, "rendered_roundtrip"):
        again = html.parse(render.render(trees[r["page_id"]]))
        assert r["first"] == model.digest(trees[r["page_id"]]) and r["second"] == model.digest(again) and r["same"] == (r["first"] == r["second"]) and r["same_text"]


def test_documents_as_markdown_one_by_one(spark):
    trees = {r["doc_id"]: markdown.parse(r["text"] or "") for r in table("documents")}
    assert {r["doc_id"]: r["semantic_sha256"] for r in rows_of(spark, "markdown_semantic")} == {i: model.digest(t) for i, t in trees.items()}


def test_block_differences_of_pairs(spark):
    trees = {r["page_id"]: html.parse(r["html"]) for r in table("pages")}
    expected = {}
    for i in {k // 2 for k in trees}:
        a, b = (Counter((c["kind"], model.digest(c)) for c in trees[k]["children"]) if k in trees else Counter() for k in (2 * i, 2 * i + 1))
        missing = Counter()
        for (kind, _), n in (a - b).items():
            missing[kind] += n
        if missing:
            expected[i] = ", ".join(f"{kind}:{n}" for kind, n in sorted(missing.items()))
    assert {r["pair"]: r["missing"] for r in rows_of(spark, "block_diff")} == expected and expected


def test_resources_of_pages(spark):
    from html.parser import HTMLParser

    class Finder(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("img", "object"):
                url = a.get("data-fullres-src") or a.get("src") or a.get("data")
                self.found.setdefault(url, ("image", a.get("alt") or "") if tag == "img" else ("file", a.get("data-attachment") or "")) if url else None

        handle_startendtag = handle_starttag

    expected = set()
    for r in table("pages"):
        finder = Finder()
        finder.found = {}
        finder.feed(r["html"] + '<img src="/a.png" data-fullres-src="/full.png" alt="A"><object data="/f.pdf" data-attachment="f.pdf"></object><img src="/full.png">')
        expected |= {(r["page_id"], k, u, *told) for k, (u, told) in enumerate(finder.found.items())}
    assert {(r["page_id"], r["place"], r["reference"], r["kind"], r["name"]) for r in rows_of(spark, "html_resources")} == expected


def shared_lines():
    def lines(t):
        return {x for x in (t or "").splitlines() if len(x) >= 30}

    items, docs = table("benchmark"), table("documents")
    return [(i, d) for i in items for d in docs if lines(i["text"]) & lines(d["text"])]


def normal_title(text):
    first = (text or "").split("\n")[0]
    return model.inline_text(unicodedata.normalize("NFC", first)).casefold()


def test_fuzzy_similarities_of_pairs_that_share_a_line(spark):
    pairs = shared_lines()
    titles = {(r["item_id"], r["doc_id"]): r["similarity"] for r in rows_of(spark, "fuzzy_title")}
    texts = {(r["item_id"], r["doc_id"]): r["similarity"] for r in rows_of(spark, "fuzzy_text")}
    assert set(titles) == set(texts) == {(i["item_id"], d["doc_id"]) for i, d in pairs}
    for i, d in pairs:
        a, b = normal_title(i["text"]), normal_title(d["text"])
        assert titles[i["item_id"], d["doc_id"]] == pytest.approx(1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio())
        a, b = i["text"][:5000], d["text"][:5000]
        matcher = difflib.SequenceMatcher(None, a, b)
        matched = sum(m.size for m in matcher.get_matching_blocks())
        assert texts[i["item_id"], d["doc_id"]] == pytest.approx(max(matcher.ratio(), 0.95 * matched / min(len(a), len(b))))


def test_greedy_links_of_events(spark):
    import hashlib

    def order(i):
        return hashlib.sha256(str(i).encode()).hexdigest()[:32]

    events = table("events")
    by_key = {}
    for e in events:
        by_key.setdefault((e["user_id"], e["event_type"]), []).append((e["event_id"], e["ts"]))
    expected = set()
    for own in by_key.values():
        used = set()
        for i, at in sorted((x for x in own if x[0] % 2 == 0), key=lambda x: order(x[0])):
            near = [j for j, other in own if j % 2 == 1 and j not in used and abs(int(at.timestamp()) - int(other.timestamp())) <= 3600]
            if len(near) == 1:
                used.add(near[0])
                expected.add((i, near[0]))
    assert {(r["left_id"], r["right_id"]) for r in rows_of(spark, "greedy_time_link")} == expected


def test_assignment_is_the_best_of_its_pairs(spark):
    from skarn.plans.linkage_queries import halves_by_lines

    pairs = {(r["source_id"], r["target_id"]): r["score"] for r in halves_by_lines(spark, str(FOLDER)).collect()}
    taken = rows_of(spark, "global_assignment")
    assert len({r["source_id"] for r in taken}) == len({r["target_id"] for r in taken}) == len(taken) > 5
    assert all(pairs[r["source_id"], r["target_id"]] == r["score"] > 0.2 for r in taken)
    sources, targets = (sorted({p[k] for p in pairs}) for k in (0, 1))
    size = len(sources) + len(targets)
    gain = np.zeros((size, size))
    for (s, t), v in pairs.items():
        gain[sources.index(s), targets.index(t)] = max(0.0, v - 0.2)
    prices, row_of, free, step = np.zeros(size), {}, list(range(size)), 1e-5
    while free:  # an auction, exact to size times its step
        i = free.pop()
        value = gain[i] - prices
        j = int(value.argmax())
        first, value[j] = value[j], -np.inf
        prices[j] += first - value.max() + step
        if j in row_of:
            free.append(row_of[j])
        row_of[j] = i
    assert abs(sum(r["score"] - 0.2 for r in taken) - sum(gain[i, j] for j, i in row_of.items())) <= size * step


def test_the_whole_comparison(spark):
    """Every page once; the key rules as their SQL has them; scored links within candidates, one a note, above the threshold, none better left over."""
    found = rows_of(spark, "audit_flagship")
    docs = {r["doc_id"] for r in table("documents")}
    assert sorted(r["source_page_id"] for r in found) == sorted(f"p{i}" for i in docs if i % 16 != 15)
    columns, expected = sql_rows(catalogue.oracle_sql()["key_rule_links"])
    key = {(r["source_page_id"], r["target_note_id"], r["confidence"], r["stage"]) for r in found if r["stage"] not in ("scored", "unmatched")}
    assert key == {tuple(row[columns.index(c)] for c in ("source_page_id", "target_note_id", "confidence", "stage")) for row in expected}
    assert {s for _, _, _, s in key} == {"embedded-id", "path-title-time", "semantic-hash", "section-text", "path-title", "unique-title"}
    scored = [r for r in found if r["stage"] == "scored"]
    notes = [r["target_note_id"] for r in found if r["target_note_id"]]
    assert len(notes) == len(set(notes)) and scored and all(r["score"] >= 0.45 for r in scored)
    # a page that came twice finds one of its notes, and neither is clearly the better
    for r in scored:
        if int(r["source_page_id"][1:]) % 16 == 14 and r["target_note_id"][1:] == r["source_page_id"][1:]:
            assert r["confidence"] == "ambiguous" and r["margin"] == pytest.approx(0.0)
    kinds = Counter()
    for r in rows_of(spark, "audit_findings"):
        kinds[r["kind"]] += r["n"]
    columns, expected = sql_rows(catalogue.oracle_sql()["key_rule_findings"])
    alone = Counter()
    for row in expected:
        alone[row[columns.index("kind")]] += row[columns.index("n")]
    assert set(kinds) == set(alone) and len(kinds) == 19
    # what was scored is no longer missing or unmatched, and nothing else about the key links changes
    assert kinds["source-page-missing"] == alone["source-page-missing"] - len(scored) and kinds["target-note-unmatched"] == alone["target-note-unmatched"] - len(scored)
    assert kinds["duplicate-targets"] == alone["duplicate-targets"] and kinds["empty-body"] >= alone["empty-body"]
    assert json.dumps(kinds)
