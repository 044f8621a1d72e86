"""A deterministic export plan as data: folders, notes, bodies and operations, with ids that depend on content alone.

A plan is a folder: ``folders``, ``notes`` and ``bodies`` as Parquet, and ``plan.json`` with the digests of these tables, so that the digest of
that one file binds all of the plan.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.hashing import canonical_json, digest
from skarn.functions.text import casefold, casefolded
from skarn.normalize.columns import normalized, rendered
from skarn.operators.selection import global_rank
from skarn.sources.snapshot import Folder, Snapshot, inventory_hash

#: What stands for a missing title (fixed values).
UNTITLED = {"notebook": "Untitled Notebook", "section-group": "Untitled Section Group", "section": "Untitled Section", "page": "Untitled Page"}
POLICIES = ("fail", "replace-managed")
SCHEMA_VERSION = 1
TOOL = "skarn/2"


def short_id(*parts: Column) -> Column:
    return F.substring(digest(F.concat_ws("|", *parts)), 1, 16)


def guard(manifest: dict, policy: str, n_pages: int, n_same_titles: int) -> None:
    """Refuses a plan from a source that is not complete, verified and unambiguous."""
    problems = [
        (policy not in POLICIES, "unknown conflict policy"),
        (manifest["source_backend"] == "graph", "this source is not a complete one"),
        (manifest["coverage"] != "complete", "the source's coverage is not complete"),
        (not manifest["checksums_ok"], "the source's checksums do not hold"),
        (n_pages == 0, "the source has no pages"),
        (n_same_titles > 0, "titles of notebooks are not unique"),
    ]
    found = [text for bad, text in problems if bad]
    if found:
        raise ValueError("; ".join(found))


def notebook_key(pages: DataFrame) -> Column:
    """A notebook's id, or its title where it has none."""
    title = F.coalesce("notebook_title", F.lit(""))
    return F.coalesce(F.nullif(F.col("notebook_id"), F.lit("")), title) if "notebook_id" in pages.columns else title


def same_titles(pages: DataFrame) -> int:
    """How many titles several notebooks share."""
    return pages.groupBy("notebook_title").agg(F.countDistinct(notebook_key(pages)).alias("n")).where("n > 1").count()


def page_order() -> list[Column]:
    """The total order of pages: case-folded titles from the notebook down, the place in the section, the id."""
    groups = F.coalesce("section_group_path", F.array().cast("array<string>"))
    return [casefold(F.col("notebook_title")), casefolded(groups), casefold(F.col("section_title")), F.col("page_order"), F.col("source_page_id")]


def node_key(kind: str, *parts: Column) -> Column:
    """The id of a folder: of its kind and all titles above it, as JSON."""
    arrays = [p if k else F.array(p) for k, p in enumerate(parts)]
    return F.substring(digest(F.to_json(F.concat(F.array(F.lit(kind)), *arrays))), 1, 16)


def placed(pages: DataFrame) -> DataFrame:
    """Pages with the ids of the folders that they lie in: _root, _groups (from the root down), _section."""
    text = F.array().cast("array<string>")
    groups = F.coalesce("section_group_path", text)
    section = [F.coalesce(F.col(c), F.lit("")) if c in pages.columns else F.lit("") for c in ("section_id", "section_title")]
    key = F.col("_key")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: node_key("group", key, F.slice(groups, F.lit(1), k)))
    return pages.withColumn("_key", notebook_key(pages)).withColumns(
        {
            "_root": node_key("notebook", key), "_groups": F.when(F.size(groups) > 0, prefixes).otherwise(text),
            "_section": node_key("section", key, F.concat(groups, F.array(*section))),
        }
    )


def folders(pages: DataFrame) -> DataFrame:
    """folder_id, parent_id, title, kind, level, source_key of every folder that the pages need."""
    where = placed(pages)
    groups = F.coalesce("section_group_path", F.array().cast("array<string>"))
    last = F.coalesce(F.try_element_at("_groups", F.lit(-1)), F.col("_root"))

    def named(value: Column, kind: str) -> Column:
        return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(UNTITLED[kind]))

    def row(folder: Column, parent: Column, title: Column, kind: str, level: Column, key: Column) -> Column:
        fields = {"folder_id": folder, "parent_id": parent, "title": named(title, kind), "kind": F.lit(kind), "level": level.cast("int"), "source_key": key}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    section_id = F.col("section_id") if "section_id" in pages.columns else F.lit(None).cast("string")
    root = row(F.col("_root"), F.lit(None).cast("string"), F.col("notebook_title"), "notebook", F.lit(0), F.col("_key"))
    section = row(F.col("_section"), last, F.col("section_title"), "section", F.size("_groups") + 1, F.coalesce(F.nullif(section_id, F.lit("")), "section_title", F.lit("")))
    inner = F.transform(
        F.arrays_zip(F.col("_groups").alias("id"), groups.alias("title")),
        lambda g, k: row(g["id"], F.when(k == 0, F.col("_root")).otherwise(F.get("_groups", k - 1)), g["title"], "section-group", k + 1, F.array_join(F.slice(groups, F.lit(1), k + 1), "/")),
    )
    every = where.select(F.explode(F.concat(F.array(root), inner, F.array(section))).alias("f")).select("f.*")
    return every.groupBy("folder_id").agg(*[F.min(c).alias(c) for c in ("parent_id", "title", "kind", "level", "source_key")])


def notes(pages: DataFrame, snapshot_id: str) -> DataFrame:
    """One action a page: ids, folder, title, body and its digests, sorted resource hashes, times, and its place in the total order."""
    body = rendered(F.col("semantic_json"))
    times = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("created_at", "updated_at")]
    told = placed(pages).withColumn("body", body)
    ranked = global_rank(told, page_order())
    return ranked.select(
        short_id(F.lit(snapshot_id), F.col("source_page_id"), F.lit("full-export")).alias("action_id"), "source_page_id", F.col("_section").alias("folder_id"),
        F.coalesce(F.nullif(F.col("page_title"), F.lit("")), F.lit(UNTITLED["page"])).alias("title"), "body", digest(F.col("body")).alias("body_sha256"),
        "semantic_sha256", F.array_sort(F.array_distinct("resource_hashes")).alias("resource_hashes"), *times, "page_order", "place",
    )


def plan_id(folder_rows: DataFrame, note_rows: DataFrame, snapshot_id: str, policy: str, inventory: str = "") -> str:
    """A digest of the whole plan, the order of pages included: of digests of its rows, which hold their places."""

    def rows_digest(df: DataFrame, *columns: str) -> str:
        # a sum of row digests is combined on the executors, whatever the number of rows
        parts = [F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
        row = df.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)]).first()
        return ",".join(str(x) for x in row)

    spec = {
        "snapshot": snapshot_id, "inventory": inventory, "policy": policy, "folders": rows_digest(folder_rows, "folder_id", "parent_id", "title", "kind", "source_key"),
        "notes": rows_digest(note_rows, "action_id", "folder_id", "title", "body_sha256", "semantic_sha256", "resource_hashes", "place"),
    }
    return hashlib.sha256(canonical_json(spec).encode()).hexdigest()[:16]


def operations(
    folder_rows: DataFrame, note_rows: DataFrame, existing: DataFrame | None = None, old_roots: DataFrame | None = None
) -> DataFrame:
    """What an export would do, in order (``place``, over all phases) and without doing it.

    Folders by level, resources, notes, then the check of each staged root, its promotion, and the removal of the roots that it replaces.
    ``existing(kind, subject)``: what an earlier run of the same plan has made; ``old_roots(id)``: roots of other plans.
    """

    def step(phase: int, df: DataFrame, kind: str, subject: Column, first: Column) -> DataFrame:
        return df.select(F.lit(phase).alias("phase"), first.cast("long").alias("first"), F.lit(kind).alias("kind"), subject.alias("subject"))

    roots = folder_rows.where("parent_id is null")
    none = F.lit(0)
    resources = note_rows.select(F.explode("resource_hashes").alias("h")).distinct()
    made = [
        step(0, folder_rows, "create-folder", F.col("folder_id"), F.col("level")), step(1, resources, "upload-resource", F.col("h"), none),
        step(2, note_rows, "create-note", F.col("action_id"), F.col("place")),
    ]
    every = reduce(DataFrame.unionByName, made)
    if existing is not None:
        every = every.join(existing.select("kind", "subject").distinct(), ["kind", "subject"], "left_anti").select("phase", "first", "kind", "subject")
    after = [step(3, roots, "verify-staged-root", F.col("folder_id"), none), step(4, roots, "promote-root", F.col("folder_id"), none)]
    if old_roots is not None:
        after.append(step(5, old_roots, "trash-old-root", F.col("id"), none))
    every = reduce(DataFrame.unionByName, [every, *after])
    return global_rank(every, [F.col("phase"), F.col("first"), F.col("subject")]).select("place", "phase", "kind", "subject")


def write_plan(pages: DataFrame, manifest: dict, path: str, policy: str = "fail", fingerprint: str = "", manifest_sha256: str = "") -> dict:
    """Writes the plan of all pages; returns what ``plan.json`` holds.

    ``manifest``: snapshot_id, source_backend, coverage, checksums_ok and inventory_hash of the source.
    """
    spark = pages.sparkSession
    out = Folder(spark, path)
    if out.exists():
        raise FileExistsError(path)
    guard(manifest, policy, pages.count(), same_titles(pages))
    note_rows = notes(pages, manifest["snapshot_id"])
    note_rows.select("action_id", "body").write.parquet(f"{path}/bodies")
    note_rows.drop("body").write.parquet(f"{path}/notes")
    folders(pages).write.parquet(f"{path}/folders")
    tables = {k: spark.read.parquet(f"{path}/{k}") for k in ("folders", "notes", "bodies")}
    header = {
        "export_plan_schema_version": SCHEMA_VERSION, "tool_version": TOOL, "created_at_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "plan_id": plan_id(tables["folders"], tables["notes"], manifest["snapshot_id"], policy, manifest.get("inventory_hash", "")),
        "conflict_policy": policy, "source_snapshot_id": manifest["snapshot_id"], "source_inventory_hash": manifest.get("inventory_hash", ""),
        "source_manifest_hash": manifest_sha256, "target_instance_fingerprint": fingerprint, "content_mode": "mixed-html-markdown",
        "n_folders": tables["folders"].count(), "n_notes": tables["notes"].count(), "tables": {k: inventory_hash(t) for k, t in tables.items()},
    }
    out.write_text("plan.json", json.dumps(header, sort_keys=True, indent=1))
    return header


def plan_of_snapshot(spark: SparkSession, source: str, path: str, policy: str = "fail", fingerprint: str = "") -> dict:
    """The plan of a published snapshot, which must be complete and unchanged."""
    snapshot = Snapshot(spark, source)
    told = snapshot.manifest
    manifest = {
        "snapshot_id": told["snapshot_id"], "source_backend": told.get("source_backend", ""), "coverage": told["coverage_status"],
        "checksums_ok": not snapshot.checksum_issues(), "inventory_hash": told["checksums"].get("pages", ""),
    }
    pages = snapshot.table("pages").withColumnRenamed("semantic_model_sha256", "semantic_sha256")
    unread = F.col("semantic_json").isNull()  # records of scans that kept the raw body only
    tree = normalized(F.coalesce("raw_content_format", F.lit("html")), F.when(unread, F.col("raw_content")))["semantic_json"]
    pages = pages.withColumn("semantic_json", F.coalesce("semantic_json", tree))
    return write_plan(pages, manifest, path, policy, fingerprint, hashlib.sha256(snapshot.folder.read_text("manifest.json").encode()).hexdigest())


def load_plan(spark: SparkSession, path: str) -> tuple[dict, str, dict[str, DataFrame]]:
    """What ``plan.json`` holds, its digest, and the plan's tables, which must be those that it was written with."""
    text = Folder(spark, path).read_text("plan.json")
    header = json.loads(text)
    if header["export_plan_schema_version"] != SCHEMA_VERSION:
        raise ValueError("unknown version of plans")
    tables = {k: spark.read.parquet(f"{path}/{k}") for k in header["tables"]}
    changed = [k for k, expected in header["tables"].items() if inventory_hash(tables[k]) != expected]
    if changed:
        raise ValueError(f"the plan was changed after it was written: {', '.join(changed)}")
    return header, hashlib.sha256(text.encode()).hexdigest(), tables


def approval(plan_bytes: bytes, operator: str, note: str = "") -> dict:
    return {"export_approval_schema_version": 1, "export_plan_sha256": hashlib.sha256(plan_bytes).hexdigest(), "operator": operator, "note": note}


def dry_run(
    plan: tuple[dict, str, dict[str, DataFrame]], given: dict, folders_there: DataFrame, notes_there: DataFrame, resources_there: DataFrame
) -> tuple[dict, DataFrame]:
    """The receipt of a dry run against what a target holds, and its operations.

    Listings: folders (id, parent_id, title, user_data), notes (id, parent_id, source_url, resource_ids) and resources (id, sha256). Nothing is sent.
    """
    from skarn.plans import inspect

    header, sha256, tables = plan
    counts = inspect.profile_counts(folders_there, notes_there, resources_there)
    roots = inspect.root_states(folders_there, header["plan_id"])
    states = {r["kind"]: r["count"] for r in roots.groupBy("kind").count().collect()}  # at most four rows
    fingerprint = inspect.instance_fingerprint(folders_there)
    mine = tables["folders"].where("parent_id is null").select("title")
    problems = [
        (given.get("export_plan_sha256") != sha256, "the approval is for another plan"),
        (bool(header["target_instance_fingerprint"]) and header["target_instance_fingerprint"] != fingerprint, "the plan is for another profile"),
        (states.get("foreign-staging", 0) > 0, "another plan's export is not finished"),
        (header["conflict_policy"] == "fail" and states.get("old", 0) > 0, "there is a managed export already"),
        (roots.where("kind = 'unmanaged'").join(mine, "title", "left_semi").limit(1).count() > 0, "a notebook of the user's own has the title of a planned one"),
    ]
    found = [text for bad, text in problems if bad]
    url = F.concat(F.lit("onenote://page/"), F.col("source_page_id"))
    marked = folders_there.where(inspect.marker("plan_id") == header["plan_id"]).select(F.lit("create-folder").alias("kind"), inspect.marker("folder_id").alias("subject"))
    noted = tables["notes"].withColumn("source_url", url).join(notes_there.select("source_url").distinct(), "source_url", "left_semi")
    own = folders_there.where(inspect.marker("plan_id") == header["plan_id"])
    resumed = noted.select(F.lit("create-note").alias("kind"), F.col("action_id").alias("subject")) if not own.isEmpty() else marked.limit(0)
    existing = reduce(DataFrame.unionByName, [marked, resumed, resources_there.where("sha256 is not null").select(F.lit("upload-resource").alias("kind"), F.col("sha256").alias("subject"))])
    steps = operations(tables["folders"], tables["notes"], existing, roots.where("kind = 'old'").select("id"))
    receipt = {
        "export_receipt_schema_version": 2, "plan_id": header["plan_id"], "export_plan_sha256": sha256,
        "approval_sha256": hashlib.sha256(canonical_json(given).encode()).hexdigest(), "target_instance_fingerprint": fingerprint,
        "live_folder_count": counts["folder"], "live_note_count": counts["note"], "live_resource_count": counts["resource"],
        "live_precondition_fingerprint": inspect.observations_fingerprint(folders_there.select(F.to_json(F.struct("id", "parent_id", "title")).alias("f")), "f"),
        "result": "failed" if found else "ok", "problems": found, "mutating_requests_sent": 0,
    }
    return receipt, steps.limit(0) if found else steps


def preflight(plan_bytes: bytes, plan: dict, given: dict, receipt: dict, source: dict, waivers: set[str]) -> list[str]:
    """Why a plan must not be applied: its chain of digests, its source, and what was not confirmed."""
    actual = hashlib.sha256(plan_bytes).hexdigest()
    checks = [
        (given.get("export_plan_sha256") == actual, "the approval is for another plan"),
        (receipt.get("export_plan_sha256") == actual, "the dry run was for another plan"),
        (receipt.get("approval_sha256") == hashlib.sha256(canonical_json(given).encode()).hexdigest(), "the dry run was for another approval"),
        (receipt.get("result") == "ok", "the dry run did not end well"),
        (plan.get("source_snapshot_id") == source.get("snapshot_id"), "the source is another snapshot"),
        (plan.get("source_inventory_hash") == source.get("inventory_hash"), "the source has changed"),
        ("sync-complete" in waivers, "synchronisation is not confirmed"),
        ("full-replace" in waivers, "replacement is not confirmed"),
        (bool(plan.get("backup")) or "no-backup" in waivers, "there is no backup"),
    ]
    return [text for good, text in checks if not good]
