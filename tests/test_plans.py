import json

import pytest
from pyspark.sql import functions as F

from skarn.normalize import model
from skarn.normalize.columns import with_normalized
from skarn.plans import audit, catalogue, export, validate
from skarn.sinks import reports

COLUMNS = (
    "id string, title string, path array<string>, body string, created_at string, updated_at string, embedded_page_id string, page_level int, "
    "resources array<struct<sha256:string,status:string,is_image:boolean>>"
)


def records(spark, rows):
    """Rows: id, title, body, and what differs from the defaults."""
    full = []
    for row in rows:
        more = row[3] if len(row) > 3 else {}
        full.append((row[0], row[1], more.get("path", ["Work", "Tasks"]), row[2], more.get("created"), more.get("updated"), more.get("embedded"), more.get("level", 1), more.get("resources", [])))
    df = with_normalized(spark.createDataFrame(full, COLUMNS), F.lit("markdown"), F.col("body"))
    hashes = F.array_sort(F.filter(F.transform("resources", lambda r: r["sha256"]), lambda h: h.isNotNull()))
    df = df.withColumnsRenamed({"id": "record_id", "links": "link_targets", "n_images": "image_count", "n_attachments": "attachment_count"}).withColumns(
        {"resource_hashes": hashes, "page_title": F.col("title"), "raw_content_format": F.lit("markdown")}
    )
    return audit.prepared(df, "record_id", "title", F.col("path"))


def links(found):
    return {r["source_page_id"]: (r["target_note_id"], r["confidence"], r["stage"]) for r in found.collect() if r["source_page_id"]}


LONG = "\n\n".join(f"This is paragraph number {k} of a text that is long enough to be told apart." for k in range(6))


def test_stages_and_scores(spark):
    t = "2024-01-01T10:00:00Z"
    pages = records(spark, [
        ("p1", "Anything", "a body", {"embedded": None}), ("p2", "Plan", "plan body", {"created": t}), ("p3", "Old title", "unique body of this page, unlike others", {"created": t}),
        ("p4", "Report", LONG, {"created": t}), ("p5", "Nowhere", "nothing like it exists anywhere else", {"created": t}), ("p6", "No time", "short one", {}),
    ])
    notes = records(spark, [
        ("n1", "Else", "other", {"embedded": "p1"}), ("n2", "Plan", "changed body", {"created": "2024-01-01T10:01:30Z"}),
        ("n3", "New title", "unique body of this page, unlike others", {"path": ["X"]}), ("n4", "Report", LONG[: len(LONG) // 2], {"created": "2024-01-01T12:00:00Z"}),
        ("n6", "No time", "quite different", {}), ("n7", "Extra", "only here", {}),
    ])
    found = audit.match(pages, notes)
    got = links(found)
    assert got["p1"] == ("n1", "exact", "embedded-id") and got["p2"] == ("n2", "exact", "path-title-time")
    assert got["p3"] == ("n3", "exact", "semantic-hash") and got["p6"] == ("n6", "high-confidence", "path-title")
    assert got["p4"][0] == "n4" and got["p4"][2] == "scored" and got["p5"] == (None, "unmatched", "unmatched")
    assert [r["target_note_id"] for r in found.collect() if r["source_page_id"] is None] == ["n7"]
    kinds = {(r["kind"], r["source_page_id"], r["target_note_id"]) for r in audit.findings(pages, notes, found).collect()}
    assert ("source-page-missing", "p5", None) in kinds and ("target-note-unmatched", None, "n7") in kinds
    assert ("truncated-text", "p4", "n4") in kinds and ("semantic-difference", "p2", "n2") in kinds and ("wrong-placement", "p3", "n3") in kinds


def test_duplicate_placeholders_are_not_linked(spark):
    pages = records(spark, [("p1", "Untitled page", ""), ("p2", "Untitled page", "")])
    notes = records(spark, [("n1", "", ""), ("n2", "Untitled", "")])
    assert {v[1] for v in links(audit.match(pages, notes)).values()} <= {"unmatched", "ambiguous"}


def test_pair_findings(spark):
    image = lambda h, status="ok": [(h, status, True)]
    t = "2024-01-01T00:00:00Z"
    pages = records(spark, [
        ("p1", "A", "text " * 50, {"created": t}), ("p2", "B", "same", {"created": t, "resources": image("h1"), "level": 2}), ("p3", "C", "x", {"created": t}),
    ])
    notes = records(spark, [
        ("n1", "A", "", {"embedded": "p1", "created": "2024-01-05T00:00:00Z"}), ("n2", "", "same", {"embedded": "p2", "created": t}),
        ("n3", "C", "x", {"embedded": "p3", "created": t, "resources": image(None, "missing")}), ("n4", "D", "y", {"embedded": "p9"}), ("n5", "E", "z", {"embedded": "p9"}),
    ])
    found = {(r["kind"], r["source_page_id"]): (r["evidence"], r["cause"]) for r in audit.findings(pages, notes, audit.match(pages, notes)).collect()}
    assert found[("empty-body", "p1")] == ("confirmed", "migration-loss") and found[("lost-timestamps", "p1")][0] == "confirmed"
    assert found[("resource-hash-mismatch", "p2")] == ("uncertain", "format-conversion") and ("lost-hierarchy", "p2") in found and ("placeholder-title", "p2") in found
    assert found[("broken-resource-reference", "p3")] == ("confirmed", "unknown") and found[("duplicate-targets", "p9")] == ("confirmed", "migration-loss")


def test_export_plan_is_deterministic(spark):
    schema = "source_page_id string, notebook_title string, section_group_path array<string>, section_title string, page_order int, page_title string, semantic_json string, semantic_sha256 string, resource_hashes array<string>"
    tree = '{"kind":"doc","version":"2","children":[]}'
    rows = [("p1", "N", ["G"], "S", 0, "A", tree, "d", ["b", "a", "a"]), ("p2", "n", None, " ", 1, "", tree, "d", []), ("p3", "N", ["g"], "S", 0, "C", tree, "d", ["a"])]
    plans = []
    for order in (rows, rows[::-1]):
        pages = spark.createDataFrame(order, schema)
        folders, notes = export.folders(pages), export.notes(pages, "snap")
        plans.append(export.plan_id(folders, notes, "snap", "fail"))
    assert plans[0] == plans[1] != export.plan_id(folders, notes, "other", "fail")
    moved = export.notes(spark.createDataFrame([(r[0], *r[1:4], 5 - r[4], *r[5:]) for r in rows], schema), "snap")
    assert export.plan_id(folders, moved, "snap", "fail") != plans[0] or [r["place"] for r in moved.collect()] == [r["place"] for r in notes.collect()]
    assert sorted((r["level"], r["title"], r["kind"]) for r in folders.collect()) == [
        (0, "N", "notebook"), (0, "n", "notebook"), (1, "G", "section-group"), (1, "Untitled Section", "section"), (1, "g", "section-group"), (2, "S", "section"), (2, "S", "section"),
    ]
    parents = {r["folder_id"]: r["parent_id"] for r in folders.collect()}
    assert all(p is None or p in parents for p in parents.values()) and {r["folder_id"] for r in notes.collect()} <= set(parents)
    # titles are compared case-folded: " " and "S", then the group, whatever its case
    assert [r["source_page_id"] for r in notes.orderBy("place").collect()] == ["p2", "p1", "p3"] and notes.where("title = 'Untitled Page'").count() == 1
    steps = export.operations(folders, notes).orderBy("place").collect()
    assert [r["kind"] for r in steps] == ["create-folder"] * 7 + ["upload-resource"] * 2 + ["create-note"] * 3 + ["verify-staged-root"] * 2 + ["promote-root"] * 2
    assert [r["place"] for r in steps] == list(range(1, 17))
    with pytest.raises(ValueError, match="coverage"):
        export.guard({"source_backend": "com", "coverage": "partial", "checksums_ok": True}, "fail", 1, 0)
    assert export.same_titles(spark.createDataFrame([("a", "N"), ("b", "N"), ("c", "M")], "notebook_id string, notebook_title string")) == 1
    approval = export.approval(b"plan", "me")
    assert "the dry run was for another plan" in export.preflight(b"plan", {}, approval, {}, {}, set())


def test_validation_issues(spark):
    schema = "id string, title string, path array<string>"
    planned = spark.createDataFrame([("a", "A", ["x"]), ("b", "B", ["x"]), ("c", "C", ["x"]), ("d", "D", ["x"])], schema)
    found = spark.createDataFrame([("a", "A!", ["y"]), ("b", "B", ["x"]), ("b", "B", ["x"]), ("d", "D", ["x"]), ("z", "Z", ["x"]), (None, "?", ["x"])], schema)
    assert sorted((r["kind"], r["id"]) for r in validate.note_issues(planned, found).collect() if r["id"]) == [
        ("duplicate-exported-note", "b"), ("exported-note-missing", "c"), ("unexpected-exported-source-id", "z"), ("wrong-export-path", "a"), ("wrong-export-title", "a"),
    ]
    assert validate.note_issues(planned, found).where("id is null").first()["kind"] == "unexpected-note-without-source-id"
    assert validate.snapshot_issues({"snapshot_id": "a", "coverage": "partial", "checksums_ok": True}, {"snapshot_id": "b", "coverage": "complete", "checksums_ok": False}, {"source_snapshot_id": "x"}) == ["wrong-source-snapshot", "source-coverage-not-complete", "target-checksum"]


def test_findings_carry_title_path_and_details(spark):
    t = "2024-01-01T00:00:00Z"
    pages = records(spark, [("p1", "A", "# head\n\nbody text\n\n- x", {"created": t}), ("p2", "Alone", "nobody has this")])
    notes = records(spark, [("n1", "A", "body text", {"embedded": "p1", "created": t}), *[(f"d{k}", "D", f"dup {k}", {"embedded": "gone", "path": ["X"]}) for k in range(3)]])
    found = {(r["kind"], r["source_page_id"]): r for r in audit.findings(pages, notes, audit.match(pages, notes)).collect()}
    other = found["semantic-difference", "p1"]
    assert (other["title"], other["path"]) == ("A", ["Work", "Tasks"]) and other["details"]["missing_blocks"] == "2" and other["details"]["missing_by_kind"] == "heading:1, list:1"
    assert found["source-page-missing", "p2"]["title"] == "Alone" and found["source-page-missing", "p2"]["details"] == {"visible_text_length": "15"}
    twice = found["duplicate-targets", "gone"]
    assert twice["details"]["n_notes"] == "3" and sorted(twice["details"]["note_ids"].split(", ")) == ["d0", "d1", "d2"] and twice["path"] == ["X"]
    assert twice["details"]["note_ids"].startswith(twice["target_note_id"])


def test_drift_is_a_day_after_the_import_and_softens_losses_of_content_only(spark):
    t, late = "2024-01-01T00:00:00Z", "2024-01-03T00:00:01Z"
    pages = records(spark, [("p1", "A", "one text", {"created": t, "updated": "2024-01-01T23:00:00Z"}), ("p2", "B", "two text", {"created": t, "updated": late})])
    notes = records(spark, [("n1", "A", "", {"embedded": "p1", "created": t, "path": ["Y"]}), ("n2", "B", "", {"embedded": "p2", "created": "2024-01-01T01:00:00Z", "path": ["Y"]})])
    found = {(r["kind"], r["source_page_id"]): (r["evidence"], r["cause"]) for r in audit.findings(pages, notes, audit.match(pages, notes)).collect()}
    assert ("source-drift", "p1") not in found and found["source-drift", "p2"] == ("informational", "source-drift")
    assert found["empty-body", "p1"] == ("confirmed", "migration-loss") and found["empty-body", "p2"] == ("uncertain", "source-drift")
    assert found["semantic-difference", "p2"] == ("uncertain", "source-drift") and found["wrong-placement", "p2"] == ("informational", "migration-loss")


def test_reports(spark, tmp_path):
    pages = records(spark, [("p1", "A", "only in the source <b>")])
    notes = records(spark, [("n1", "B", "only in the target")])
    matches = audit.match(pages, notes)
    found = audit.findings(pages, notes, matches)
    counts = reports.summary(matches, found)
    assert counts["confidence"] == {"unmatched": 1} and counts["kind"]["source-page-missing"] == 1
    whole = "".join(reports.html_parts("R & D", counts, matches, found))
    assert "source-page-missing" in whole and "R &amp; D" in whole and whole.count("<tr data-kind") == 2 and whole.count("<tr data-confidence") == 2
    many = found.crossJoin(spark.range(1500)).drop("id")  # all of them are written
    assert "".join(reports.html_parts("many", counts, matches, many)).count("<tr data-kind") == 3000
    assert len(json.loads("".join(reports.json_parts(counts, matches, many)))["findings"]) == 3000
    reports.write_reports(matches, found, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "missing-pages")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "findings")).count() == 2


def test_catalogue_names_match():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 35
    assert model.NORMALIZER


def test_target_inspection(spark):
    from skarn.plans import inspect

    mark = '{"export":{"plan_id":"p","folder_id":"f1","state":"published"}}'
    folders = spark.createDataFrame([("a", "", "A", mark), ("b", "a", "B", None), ("c", "", "C", None)], "id string, parent_id string, title string, user_data string")
    notes = spark.createDataFrame([("n1", "b", "u1", ["r1"]), ("n2", "c", "u2", [])], "id string, parent_id string, source_url string, resource_ids array<string>")
    resources = spark.createDataFrame([("r1",), ("r2",)], "id string")
    planned = spark.createDataFrame([("u1",)], "source_url string")
    assert {r["id"]: r["kind"] for r in inspect.root_states(folders, "p").collect()} == {"a": "current", "c": "unmanaged"}
    assert sorted(r["id"] for r in inspect.managed(folders).collect()) == ["a", "b"]
    found = sorted((r["kind"], r["id"]) for r in inspect.ownership_problems(folders, notes, resources, planned).collect())
    assert found == [
        ("folder-without-marker", "b"), ("folder-without-marker", "c"), ("note-not-of-the-plan", "n2"), ("note-outside-managed-folders", "n2"), ("unmarked-resource", "r2"),
    ]
    keys = spark.createDataFrame([("f1",), ("u1",), ("gone",)], "key string")
    assert {r["key"]: r["state"] for r in inspect.plan_state(keys, folders, notes).collect()} == {"f1": "present", "u1": "present", "gone": "missing"}
    before = inspect.instance_fingerprint(folders)
    assert before == inspect.instance_fingerprint(folders.where("id <> 'b'")) != inspect.instance_fingerprint(folders.where("id <> 'c'"))


def test_repair_actions(spark):
    from skarn.normalize import markdown
    from skarn.plans import detect, repair

    kinds = [("truncated-text", "probable", "migration-loss", "p", "x"), ("empty-body", "confirmed", "migration-loss", "p", "y"), ("empty-body", "uncertain", "source-drift", "q", ""), ("wrong-placement", "informational", "migration-loss", "r", ""), ("semantic-difference", "probable", "migration-loss", "s", ""), ("collapsed-sources", "probable", "migration-loss", "t", "")]
    rows = [(kind, evidence, cause, page, "n", "T", ["P"], text, {}) for kind, evidence, cause, page, text in kinds]
    found = repair.actions(spark.createDataFrame(rows, detect.FINDING), "snap")
    assert [(r["source_page_id"], r["reason"]) for r in found.collect()] == [("p", "empty-body: y")]
    assert repair.actions(spark.createDataFrame(rows, detect.FINDING), "snap", include_drift=True).count() == 2
    assert "<p>a</p>" in repair.body(markdown.parse("a"), ["w <1>"], "backup", "id") and "w &lt;1&gt;" in repair.body(markdown.parse("a"), ["w <1>"], "backup", "id")


def test_stale_rows_are_normalized_again(spark):
    from skarn.normalize.columns import renormalized

    df = with_normalized(spark.createDataFrame([(1, "markdown", "*a*"), (2, "markdown", "b")], "i long, kind string, body string"), F.col("kind"), F.col("body"))
    stale = df.withColumn("normalizer_version", F.when(F.col("i") == 1, "old").otherwise(F.col("normalizer_version"))).withColumn("text", F.lit("kept"))
    assert {r["i"]: r["text"] for r in renormalized(stale, "kind", "body").collect()} == {1: "a", 2: "kept"}


def test_page_resources(spark):
    from skarn.sources import scans

    xml = '<P xmlns="x"><Image alt="i"><Data>aGk=</Data></Image><InsertedFile preferredName="f.pdf"/><InkDrawing/></P>'
    df = spark.createDataFrame([(1, xml), (2, "<broken")], "i long, xml string")
    found = scans.resources_of(df, "i", scans.page_resources(F.col("xml"))).orderBy("place").collect()
    assert [(r["reference"], r["name"], r["content"]) for r in found] == [("image:1", "i", b"hi"), ("file:1", "f.pdf", None)]
    assert df.select(scans.page_warnings(F.col("xml"))).first()[0] == ["unsupported OneNote object: InkDrawing x1"]


def test_a_moved_note_outranks_a_hundred_section_mates(spark):
    line = "a line that only the page and its moved note have"
    pages = records(spark, [("p", "Original", line + "\n\nfirst end", {"path": ["Work", "Tasks"]})])
    notes = records(spark, [(f"m{k:03}", f"Mate {k}", f"mate {k}", {"path": ["Home", "Tasks"]}) for k in range(130)] + [("z", "Elsewhere", line + "\n\nother end", {"path": ["Home", "Moved"]})])
    got = links(audit.match(pages, notes))
    assert got["p"][0] == "z"


def test_notebook_and_section_keys_fold_case_and_take_every_part(spark):
    pages = records(spark, [("p", "", "one", {"path": ["Notebook", "Straße"]})])
    notes = records(spark, [("n1", "", "two", {"path": ["Import", "NOTEBOOK", "Else"]}), ("n2", "", "three", {"path": ["X", "STRASSE"]}), ("n3", "", "four", {"path": []})])

    def keys(df, **kind):
        return {tuple(r) for r in audit.record_keys(df, "r", **kind).where("kind in ('notebook', 'section')").collect()}

    assert keys(pages) == {("p", "notebook", "notebook"), ("p", "section", "strasse")}
    assert keys(notes, every_part=True) == {
        ("n1", "notebook", "import"), ("n1", "notebook", "notebook"), ("n1", "notebook", "else"), ("n1", "section", "else"),
        ("n2", "notebook", "x"), ("n2", "notebook", "strasse"), ("n2", "section", "strasse"),
    }


def test_planned_notes_whose_page_is_gone(spark):
    planned = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, title string")
    found = spark.createDataFrame([("a", "A!"), ("b", "B!"), ("c", "C"), ("c", "C")], "id string, title string")
    source = spark.createDataFrame([("b",), ("e",)], "id string")
    assert sorted(map(tuple, validate.note_issues(planned, found, source).select("kind", "id").collect())) == [
        ("planned-source-page-missing", "a"), ("planned-source-page-missing", "c"), ("planned-source-page-missing", "d"), ("wrong-export-title", "b"),
    ]
