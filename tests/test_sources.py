import hashlib
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from skarn.sources import paged, scans, schemas, snapshot, target
from skarn.streaming import incremental


def test_snapshot_write_read_and_checks(spark, tmp_path):
    pages = spark.createDataFrame([("p1", "A"), ("p2", None)], "source_page_id string, page_title string")
    errors = spark.createDataFrame([], snapshot.ERROR)
    blobs = spark.createDataFrame([("h", bytearray(b"x")), ("h", bytearray(b"x"))], "sha256 string, content binary")
    path = str(tmp_path / "snap")
    manifest = snapshot.write_snapshot(path, {"pages": pages, "errors": errors}, {"snapshot_id": "s"}, blobs)
    assert manifest["coverage_status"] == "complete" and manifest["record_counts"] == {"pages": 2, "errors": 0}
    again = snapshot.Snapshot(spark, path)
    assert again.checksum_issues() == [] and spark.read.parquet(f"{path}/blobs").count() == 1
    expected = sorted(["p1", "p2"], key=lambda i: hashlib.sha256(i.encode()).hexdigest())
    assert [r["source_page_id"] for r in again.table("pages", "source_page_id").orderBy("ord").collect()] == expected
    with pytest.raises(FileExistsError):
        snapshot.write_snapshot(path, {"pages": pages}, {})
    pages.limit(1).write.mode("overwrite").parquet(f"{path}/pages")
    assert again.checksum_issues() == ["pages: mismatch"]
    with pytest.raises(ValueError):
        again.folder.read_text("../x")
    with pytest.raises(FileNotFoundError):
        snapshot.Snapshot(spark, str(tmp_path))


def test_inventory_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    assert snapshot.inventory_hash(a) == snapshot.inventory_hash(a.orderBy(F.desc("i")).repartition(3)) != snapshot.inventory_hash(a.limit(1))


def test_strict_columns_and_schemas(spark):
    with pytest.raises(ValueError):
        snapshot.check_columns(spark.createDataFrame([(1,)], "odd long"), snapshot.PAGE)
    found = schemas.json_schemas()
    assert len(found) >= 19 and {"page-record", "note-record", "finding", "audit-result", "export-plan", "export-dry-run-receipt"} <= set(found)
    assert all(s["type"] == "object" and s["additionalProperties"] is False for s in found.values())
    page = found["page-record"]["properties"]
    assert page["page_level"]["type"] == ["integer", "null"] and page["resources"]["items"]["properties"]["is_image"]["type"] == ["boolean", "null"]
    assert found["audit-result"]["properties"]["findings"]["items"]["properties"]["path"]["type"] == ["array", "null"]


def test_inventory_hash_is_that_of_the_sorted_canonical_json(spark):
    rows = [(k, None if k % 3 else f"t{k}", ["b", "a"]) for k in range(40)]
    df = spark.createDataFrame(rows, "i long, t string, l array<string>")
    texts = sorted(json.dumps({"i": i, "t": t, "l": x}, sort_keys=True, separators=(",", ":")) for i, t, x in rows)
    assert snapshot.inventory_hash(df) == hashlib.sha256(f"[{','.join(texts)}]".encode()).hexdigest()
    deep = snapshot.inventory_hash(df, leaf_rows=4)
    assert deep == snapshot.inventory_hash(df.repartition(5).orderBy(F.desc("i")), leaf_rows=4) != snapshot.inventory_hash(df.where("i <> 7"), leaf_rows=4)


@pytest.mark.parametrize("broken_copy", [False, True])
def test_a_folder_that_cannot_be_renamed_is_copied_with_the_manifest_last(spark, tmp_path, monkeypatch, broken_copy):
    pages = spark.createDataFrame([("p1", "A"), ("p2", None)], "source_page_id string, page_title string")
    tried, waits = [], []

    def refused(self, target):
        tried.append(target)
        raise OSError("held by another process")

    monkeypatch.setattr(snapshot.Folder, "rename_to", refused)
    monkeypatch.setattr(snapshot.publish, "__defaults__", (waits.append,))
    if broken_copy:
        monkeypatch.setattr(snapshot, "checksum_issues", lambda *_: ["pages: mismatch"])
        with pytest.raises(OSError, match="mismatch"):
            snapshot.write_snapshot(str(tmp_path / "snap"), {"pages": pages}, {"snapshot_id": "s"})
        assert not (tmp_path / "snap").exists()
    else:
        snapshot.write_snapshot(str(tmp_path / "snap"), {"pages": pages}, {"snapshot_id": "s"})
        assert snapshot.Snapshot(spark, str(tmp_path / "snap")).checksum_issues() == [] and not (tmp_path / "snap.staging").exists()
    assert len(tried) == 8 and waits == [0.05 * 2**k for k in range(7)]


def test_scans(spark):
    xml = '<N xmlns="x"><Notebook ID="n" name="N"><Section ID="s" name="S"><Page ID="p1" name="A"/><Page ID="p2" name="B"/></Section></Notebook></N>'
    pages = scans.hierarchy_pages(spark.createDataFrame([(xml,), (None,)], "xml string"), "xml")
    assert pages.count() == 2
    kept, counts = scans.without_excluded(pages, spark.createDataFrame([("p2",), ("gone",)], "page_id string"))
    assert [r["page_id"] for r in kept.collect()] == ["p1"] and tuple(counts.first()) == (1, 1)
    with pytest.raises(ValueError):
        scans.without_excluded(pages, spark.createDataFrame([("a",), ("a",)], "page_id string"))
    files = spark.createDataFrame([("S/a (On 1-2-2024)", "p1", 5, "S/a"), ("S/A", "p2", 9, "S/A"), ("S/b", "p3", 1, "S/b")], "stem string, path string, modified long, k string")
    assert sorted((r["section_key"], r["path"], r["n_skipped"]) for r in scans.latest_sections(files, F.col("k"), F.col("stem")).collect()) == [("s/a", "p2", 1), ("s/b", "p3", 0)]
    notes = spark.createDataFrame([("n", "x :/" + "a" * 32)], "note_id string, body string")
    attached = spark.createDataFrame([("n", "b" * 32)], "note_id string, ref string")
    assert sorted((r["ref"][0], r["status"]) for r in scans.referenced_resources(notes, attached).collect()) == [("a", "missing"), ("b", "ok")]


def test_pagination():
    asked = []

    def fetch(query):
        asked.append(query["page"])
        return {"items": [{"i": query["page"]}], "has_more": query["page"] < 3}

    assert [r["i"] for r in paged.offset_pages(fetch)] == [1, 2, 3] == asked
    answers = {"u?f=1": {"value": [1], "@odata.nextLink": "u2"}, "u2": {"value": [2]}}
    assert list(paged.cursor_pages(answers.__getitem__, "u", f=1)) == [1, 2]


def test_retries(monkeypatch):
    waits, calls = [], []

    def opened(request, timeout):
        calls.append(request.get_method())
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return io.BytesIO(json.dumps({"ok": 1}).encode())

    monkeypatch.setattr(paged.urllib.request, "urlopen", opened)
    assert paged.get_json("http://u", None, waits.append) == {"ok": 1}
    assert waits == [0.5, 1.0] and set(calls) == {"GET"}


def test_incremental_stream(spark, tmp_path):
    schema = "id string, body string, at timestamp"
    row = "select 'a' as id, 'same  text' as body, timestamp'2024-01-01 00:00:00' as at"
    spark.sql(row).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    target = incremental.digests(spark.createDataFrame([("t", "same text", None)], schema), "id", "body", "at")
    query = incremental.linked(incremental.digests(stream, "id", "body", "at"), target).writeStream.format("memory").queryName("linked").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["id"], r["target_id"]) for r in spark.table("linked").collect()] == [("a", "t")]


FOLDERS = [
    {"id": "f1", "parent_id": "", "title": "Work", "user_data": None}, {"id": "f2", "parent_id": "f1", "title": "Tasks", "user_data": None},
    {"id": "f3", "parent_id": "", "title": "Bin", "user_data": None, "deleted_time": 5},
]
NOTES = [
    {"id": "n1", "parent_id": "f2", "title": "A", "body": f"# T\n\nsee :/{'a' * 32} and ![i](:/{'b' * 32})", "markup_language": 1, "source_url": "onenote://page/p%201", "created_time": 1704067200000, "user_created_time": 1704067200000},
    {"id": "n2", "parent_id": "f3", "title": "B", "body": "<p>x</p>", "markup_language": 2}, {"id": "n3", "parent_id": "f1", "title": "C", "body": "other:onenote_page_id=q mine:onenote_page_id=p%2F2", "markup_language": 1, "is_conflict": 1},
    {"id": "n4", "parent_id": "f1", "title": {"odd": 1}, "markup_language": "many"}, {"title": "no id"},
]
RESOURCES = [{"id": "b" * 32, "title": "i.png", "mime": "image/png", "size": 3}]


@pytest.fixture
def address():
    """A target that serves pages of two rows and refuses fields that it does not know."""
    import http.server
    import threading
    import urllib.parse

    data = {"folders": FOLDERS, "notes": NOTES, "resources": RESOURCES}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urllib.parse.urlparse(self.path)
            query = urllib.parse.parse_qs(parts.query)
            page, fields = int(query.get("page", ["1"])[0]), query.get("fields", [""])[0].split(",")
            if "deleted_time" in fields and parts.path == "/notes":
                self.send_response(400)
                self.end_headers()
                return
            rows = data[parts.path[1:]]
            answer = json.dumps({"items": rows[2 * page - 2 : 2 * page], "has_more": 2 * page < len(rows)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_target_is_scanned_to_a_snapshot_row_by_row(spark, tmp_path, address):
    manifest = target.scan_target(spark, address, str(tmp_path / "snap"), tool="mine")
    assert manifest["coverage_status"] == "partial" and manifest["record_counts"] == {"notes": 3, "errors": 2}
    assert manifest["scan_counts"] == {"normal_notes": 1, "trashed_notes": 1, "conflict_notes": 1, "folders": 3, "active_folders": 2, "resources": 1}
    found = snapshot.Snapshot(spark, str(tmp_path / "snap"))
    notes = {r["note_id"]: r for r in found.table("notes").collect()}
    one = notes["n1"]
    assert (one["notebook_path"], one["status"], one["embedded_page_id"], one["content_format"]) == (["Work", "Tasks"], "normal", "p 1", "markdown")
    assert one["user_created_at"] == "2024-01-01T00:00:00Z" and one["updated_at"] is None and one["image_count"] == 1
    assert [(r["source_reference"], r["status"], r["is_image"]) for r in one["resources"]] == [(":/" + "a" * 32, "missing", False), (":/" + "b" * 32, "ok", True)]
    assert (notes["n2"]["status"], notes["n2"]["content_format"]) == ("trashed", "html") and (notes["n3"]["status"], notes["n3"]["embedded_page_id"]) == ("conflict", "p/2")
    assert {r["item_id"] for r in found.table("errors").collect()} == {"n4", None}
    assert target.capabilities(address) == {"folders.user_data": True, "folders.deleted_time": True, "notes.deleted_time": False}
