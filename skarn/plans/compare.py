"""Two published snapshots compared, planned or validated: what the command line does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import times
from skarn.functions.text import document_path
from skarn.plans import audit, export, validate
from skarn.sinks import reports
from skarn.sources.snapshot import ERROR, Folder, Snapshot

#: Names of a snapshot's content columns, and what the rules call them.
CONTENT = {
    "normalized_text": "text", "normalized_text_sha256": "text_sha256", "semantic_model_sha256": "semantic_sha256", "normalizer_version": "normalizer_version",
    "raw_content_format": "raw_content_format", "image_count": "image_count", "attachment_count": "attachment_count", "link_targets": "link_targets",
    "resource_hashes": "resource_hashes", "resources": "resources", "warnings": "warnings", "semantic_json": "semantic_json",
}


def page_records(pages: DataFrame) -> DataFrame:
    path = document_path(F.col("notebook_title"), F.col("section_group_path"), F.col("section_title"))
    told = pages.select(
        F.col("source_page_id").alias("record_id"), "page_title", "page_level", path.alias("_path"), F.lit(None).cast("string").alias("embedded_page_id"), "created_at", "updated_at",
        *[F.col(a).alias(b) for a, b in CONTENT.items()],
    )
    return audit.prepared(told, "record_id", "page_title", F.col("_path"))


def note_records(notes: DataFrame) -> DataFrame:
    """Notes are compared by their users' times; the times of their rows tell when the import ran."""
    imported = times.epoch_seconds(F.col("created_at")).cast("double").alias("imported_s")
    told = notes.select(
        F.col("note_id").alias("record_id"), "title", F.col("notebook_path").alias("_path"), "embedded_page_id", "status", imported,
        F.col("user_created_at").alias("created_at"), F.col("user_updated_at").alias("updated_at"), *[F.col(a).alias(b) for a, b in CONTENT.items()],
    )
    return audit.prepared(told, "record_id", "title", F.col("_path"))


def compare(spark: SparkSession, source: str, target: str, output: str) -> dict:
    """Matches, findings and reports of two snapshots; returns the counts."""
    a, b = Snapshot(spark, source), Snapshot(spark, target)
    pages, notes = page_records(a.table("pages")), note_records(b.table("notes"))
    matches = audit.match(pages, notes)
    found = audit.findings(pages, notes, matches, all(x.manifest["coverage_status"] == "complete" for x in (a, b)))
    reports.with_names(matches, pages, notes).write.parquet(f"{output}/matches.parquet")
    found.write.parquet(f"{output}/findings.parquet")
    matches, found = spark.read.parquet(f"{output}/matches.parquet"), spark.read.parquet(f"{output}/findings.parquet")
    reports.write_reports(matches, found, f"{output}/csv")
    errors = [x.table("errors") if x.folder.exists("errors") else spark.createDataFrame([], ERROR) for x in (a, b)]
    reports.write_csv(reports.extractor_errors(*errors), f"{output}/csv/extractor-errors")
    counts = reports.summary(matches, found)
    reports.write_whole(Folder(spark, output), f"{a.manifest['snapshot_id']} and {b.manifest['snapshot_id']}", counts, matches, found)
    return counts


def check_export(spark: SparkSession, source: str, target: str, plan: str | None = None) -> DataFrame:
    """Issues of a target against the pages of its source, or of a plan; the notes in scope are normal ones under a planned notebook."""
    pages, notes = Snapshot(spark, source).table("pages"), Snapshot(spark, target).table("notes")
    own = page_records(pages)
    title = F.coalesce(F.nullif(F.col("page_title"), F.lit("")), F.lit(export.UNTITLED["page"]))
    planned = own.select("id", title.alias("title"), "path", "text_sha256", F.array_sort(F.array_distinct("resource_hashes")).alias("resource_hashes"))
    if plan is not None:
        planned = export.load_plan(spark, plan)[2]["notes"].select(F.col("source_page_id").alias("id")).join(planned, "id", "left")
    roots = pages.select(F.col("notebook_title").alias("_root")).distinct()
    scope = notes.where("status = 'normal'").join(roots, F.get("notebook_path", 0) == F.col("_root"), "left_semi")
    found = note_records(scope).select(F.col("embedded_page_id").alias("id"), "title", "path", "text_sha256", F.array_sort(F.array_distinct("resource_hashes")).alias("resource_hashes"))
    return validate.note_issues(planned, found, own.select("id"))
