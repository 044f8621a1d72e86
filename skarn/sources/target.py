"""Scans of a target through its paged interface: folders, notes and resources as a snapshot, and as listings.

Rows that are not what they should be are errors of the snapshot, one each, and make its coverage partial; they do not end the scan.
"""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skarn.functions import markup, times
from skarn.functions.hashing import digest
from skarn.normalize.columns import with_normalized
from skarn.operators.components import checkpointed
from skarn.operators.trees import tree_paths
from skarn.sources import paged, scans, snapshot

#: Fields of the target's collections (fixed values), and their types.
COLLECTIONS = {
    "folders": "id string, parent_id string, title string, user_data string, deleted_time bigint",
    "notes": "id string, parent_id string, title string, body string, markup_language int, source_url string, source_application string, created_time bigint, "
    "updated_time bigint, user_created_time bigint, user_updated_time bigint, is_conflict int, deleted_time bigint",
    "resources": "id string, title string, mime string, size bigint",
}
#: Fields that older targets lack.
OPTIONAL = {"folders": ("user_data", "deleted_time"), "notes": ("deleted_time",), "resources": ()}


def listing(spark: SparkSession, where: str, kind: str, token_env: str | None = None, optional: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a collection, from an address or from a folder of Parquet tables, and (value) what cannot be read as a row."""
    if not where.startswith(("http://", "https://")):
        held = spark.read.parquet(f"{where}/{kind}")
        for name in ("sha256", "resource_ids", "user_data"):
            if name not in held.columns:
                held = held.withColumn(name, F.lit(None).cast("array<string>" if name == "resource_ids" else "string"))
        return held, spark.createDataFrame([], "value string")
    spark.dataSource.register(paged.PagedSource)
    schema = StructType.fromDDL(COLLECTIONS[kind])
    token = os.environ.get(token_env) if token_env else None
    missing = [f for f in OPTIONAL[kind] if not paged.has_field(where, kind, f, token)] if optional is None else [f for f in OPTIONAL[kind] if f not in optional]
    asked = ",".join(f for f in schema.names if f not in missing)
    reader = spark.read.format("paged_json").option("url", f"{where}/{kind}").option("fields", asked)
    texts = checkpointed((reader.option("token_env", token_env) if token_env else reader).load())  # the target is asked once
    schema.add("_broken", "string")
    rows = texts.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = F.col("r._broken").isNull() & F.col("r.id").isNotNull()
    read = rows.where(good).select("r.*").drop("_broken")
    if kind == "resources":
        read = read.withColumn("sha256", F.lit(None).cast("string"))
    if kind == "notes":
        refs = F.transform(markup.resource_refs(F.col("body")), lambda x: x)
        read = read.withColumn("resource_ids", refs)
    return read, rows.where(~F.coalesce(good, F.lit(False))).select("value")


def note_table(folders: DataFrame, notes: DataFrame, resources: DataFrame, tool: str | None = None) -> DataFrame:
    """Notes as records of a snapshot: paths, status, formats, normalized content, and the resources that their bodies refer to."""
    trashed = folders.where("deleted_time > 0").select(F.col("id").alias("parent_id"), F.lit(True).alias("_trashed"))
    paths = tree_paths(folders.select("id", "parent_id", "title")).select(F.col("id").alias("parent_id"), F.col("path").alias("notebook_path"))
    told = notes.join(paths, "parent_id", "left").join(trashed, "parent_id", "left").withColumns(
        {
            "content_format": markup.content_format(F.col("markup_language"), F.col("body")), "status": scans.note_status(F.col("deleted_time"), F.col("is_conflict"), F.col("_trashed")),
            "embedded_page_id": markup.embedded_id(F.col("source_url"), F.col("body"), tool), "notebook_path": F.coalesce("notebook_path", F.array().cast("array<string>")),
        }
    )
    held = resources.select(F.col("id").alias("ref"), F.col("title").alias("original_filename"), F.col("mime").alias("media_type"), F.col("size").alias("byte_length"), "sha256", F.lit(True).alias("_there"))
    refs = told.select("id", F.posexplode(markup.resource_refs(F.col("body"))).alias("_k", "ref")).join(held, "ref", "left")
    fields = {
        "source_reference": F.concat(F.lit(":/"), "ref"), "original_filename": F.col("original_filename"), "sanitized_filename": markup.safe_filename(F.col("original_filename")),
        "media_type": F.col("media_type"), "byte_length": F.col("byte_length"), "sha256": F.col("sha256"), "stored_path": F.lit(None).cast("string"),
        "status": F.when(F.col("_there").isNull(), "missing").otherwise("ok"), "is_image": F.coalesce(F.startswith("media_type", F.lit("image/")), F.lit(False)), "warnings": F.array().cast("array<string>"),
    }
    one = F.struct(F.col("_k"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("r"))
    of_note = refs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("resources"))
    read = with_normalized(told.join(of_note, "id", "left"), F.col("content_format"), F.coalesce("body", F.lit("")))
    resource = F.coalesce("resources", F.array().cast(f"array<{snapshot.RESOURCE}>"))
    iso = {c: times.iso_from_epoch_ms(F.col(f"{c[:-3]}_time")) for c in ("created_at", "updated_at", "user_created_at", "user_updated_at")}
    columns = {
        "snapshot_schema_version": F.lit(snapshot.SCHEMA_VERSION), "source_backend": F.lit("target-api"), "audit_role": F.lit("target"), "note_id": F.col("id"),
        "parent_notebook_id": F.col("parent_id"), "has_body_html": F.lit(False), "raw_content": F.col("body"), "raw_content_sha256": digest(F.coalesce("body", F.lit(""))),
        "raw_content_format": F.col("content_format"), "semantic_model_sha256": F.col("semantic_sha256"), "normalized_text": F.col("text"), "normalized_text_sha256": F.col("text_sha256"),
        "visible_text_length": F.length("text"), "image_count": F.col("n_images"), "attachment_count": F.col("n_attachments"), "link_targets": F.col("links"),
        "resource_hashes": F.array_sort(F.array_distinct(F.filter(F.transform(resource, lambda r: r["sha256"]), lambda h: h.isNotNull()))), "resources": resource,
        "errors": F.array().cast("array<string>"), **iso,
    }
    kinds = StructType.fromDDL(snapshot.NOTE)
    return read.select(*[columns.get(f.name, F.col(f.name) if f.name in read.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])


def scan_target(spark: SparkSession, url: str, output: str, token_env: str | None = None, tool: str | None = None, snapshot_id: str | None = None) -> dict:
    """A snapshot of a target; returns its manifest."""
    started = now()
    found = {kind: listing(spark, url, kind, token_env) for kind in COLLECTIONS}
    (folders, _), (notes, _), (resources, _) = (found[k] for k in ("folders", "notes", "resources"))
    broken = [bad.select(F.lit(kind[:-1]).alias("scope"), F.get_json_object("value", "$.id").alias("item_id"), F.get_json_object("value", "$.title").alias("item_title"),
                         F.lit("the row cannot be read").alias("message"), F.lit("ValueError").alias("exception_type")) for kind, (_, bad) in found.items()]
    errors = broken[0].unionByName(broken[1]).unionByName(broken[2])
    records = checkpointed(note_table(folders, notes, resources, tool))
    counts = {r["status"]: r["count"] for r in records.groupBy("status").count().collect()}  # three kinds
    manifest = {
        "snapshot_id": snapshot_id or f"{started.replace(':', '')}-target", "source_backend": "target-api", "audit_role": "target", "tool_version": "skarn/2",
        "scan_started_at_utc": started, "scan_finished_at_utc": now(), "configuration": {"url": url},
        "scan_counts": {f"{k}_notes": counts.get(k, 0) for k in ("normal", "trashed", "conflict")} | {
            "folders": folders.count(), "active_folders": folders.where("coalesce(deleted_time, 0) = 0").count(), "resources": resources.count()},
    }
    return snapshot.write_snapshot(output, {"notes": records, "errors": errors}, manifest)


def capabilities(url: str, token: str | None = None) -> dict[str, bool]:
    """Which of the optional fields a target knows."""
    return {f"{kind}.{f}": paged.has_field(url, kind, f, token) for kind, fields in OPTIONAL.items() for f in fields}


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
