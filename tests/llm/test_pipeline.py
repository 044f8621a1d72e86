import random

import pytest

import corpus_pipeline
from skarn.llm import queries as llm_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(3)
    words = [f"{a}{b}" for a in ("an", "the", "ori", "ter", "li", "mo", "ka") for b in ("ma", "ne", "sto", "ring", "s", "lo", "ver", "it")]
    rows, labels = [], []
    passage = " ".join(f"shared{k}" for k in range(60))
    for k in range(300):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(60, 140)))
        if k % 10 == 1:
            text = text.replace(text.split(" ")[5], "grobble zorkish")
        if k % 10 == 2:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        if k % 10 in (3, 4):
            text = f"{text} {passage} {draw.choice(words)}"
        rows.append((k, text, "en", "s", len(text), f"extra{k}", k))
        labels.append((k, int(k % 10 != 2), int(k % 10 == 1)))
    near = rows[5][1].split(" ")
    near[10] = "changed"
    rows += [(1003, " ".join(near), "en", "s", 1, None, 1), (1004, rows[5][1] + " more", "en", "s", 1, None, 1), (0, rows[6][1].replace(" ", " so "), "en", "s", 1, None, 2)]
    rows += [(1000, rows[0][1], "en", "s", 1, "copy", 1), (1001, "", "en", "s", 0, None, None), (1002, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, places int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns, name
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        seen.append(name)
        if name == "quality":
            assert sum(i % 10 == 2 for i in gone if i < 1000) >= 25 and sum(i % 10 != 2 for i in gone if i < 1000) <= 6
        if name == "toxicity":
            assert sum(i % 10 == 1 for i in gone if i < 1000) >= 25 and sum(i % 10 != 1 for i in gone if i < 1000) <= 6
        if name == "near_duplicates":
            assert 1000 in gone and 0 in after
            assert {1003, 1004} <= gone and 5 in after and docs.where("doc_id = 0").count() == 2  # near copies go; another text of an id stays
        if name == "substrings":
            assert not gone and all("shared30" not in (r["text"] or "") for r in after.values())
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.values())
            assert all(r["places"] == before[i]["places"] and r["n_words"] == before[i]["n_words"] for i, r in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert seen == ["quality", "toxicity", "near_duplicates", "substrings"]


def test_run_and_empty_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_release_deletes_intermediate_folders(spark, folder):
    from skarn.llm import common

    assert common.written(spark.range(3), "range").count() == 3
    other = spark.newSession()
    theirs = common.written(other.range(2), "range")
    made = len(common.made_by(spark))
    assert common.release(spark) == made >= 1 and not common.made_by(spark)
    assert theirs.count() == 2 and common.release(other) == 1


def test_queries_are_registered():
    names = llm_queries.queries()
    assert [n for n in sorted(names) if n.startswith("op")] and len(names) == 10
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None
