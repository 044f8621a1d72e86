"""Snapshots: immutable folders of records, resources and errors with a manifest that comes last.

A snapshot is written to a staging folder beside its final place and published by renaming; the manifest is the
sign that it is whole. Readers refuse a folder without one, or of another schema version. Records are Parquet,
so that scans prune columns and push filters down; their digest does not depend on how they are stored.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.hashing import canonical_row, digest, record_order, sorted_digest
from skarn.operators.components import checkpointed

SCHEMA_VERSION = 1
RESOURCE = "struct<source_reference:string,original_filename:string,sanitized_filename:string,media_type:string,byte_length:bigint,sha256:string,stored_path:string,status:string,is_image:boolean,warnings:array<string>>"
CONTENT = (
    "raw_content string, semantic_json string, raw_content_path string, raw_content_sha256 string, raw_content_format string, semantic_model_path string, semantic_model_sha256 string, "
    "normalizer_version string, normalized_text string, normalized_text_sha256 string, visible_text_length long, image_count long, "
    f"attachment_count long, link_targets array<string>, resource_hashes array<string>, resources array<{RESOURCE}>, warnings array<string>, errors array<string>"
)
PAGE = (
    f"snapshot_schema_version int, source_backend string, audit_role string, source_page_id string, notebook_id string, notebook_title string, section_id string, "
    f"section_title string, section_group_path array<string>, page_title string, page_level int, page_order int, created_at string, updated_at string, {CONTENT}"
)
NOTE = (
    f"snapshot_schema_version int, source_backend string, audit_role string, note_id string, parent_notebook_id string, title string, source_url string, "
    f"source_application string, notebook_path array<string>, markup_language int, content_format string, has_body_html boolean, status string, created_at string, "
    f"updated_at string, user_created_at string, user_updated_at string, embedded_page_id string, {CONTENT}"
)
ERROR = "scope string, item_id string, item_title string, message string, exception_type string"
KINDS = {"pages": PAGE, "notes": NOTE, "errors": ERROR}


class Folder:
    """Files of any Hadoop file system, through the session's own configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name!r} leaves the snapshot")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def write_parts(self, name: str, parts: Iterable[str]) -> None:
        """One file of many pieces, none of which is held."""
        out = self.fs.create(self.at(name), False)
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size > 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
        out.close()

    def read_text(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        return text

    def rename_to(self, target: str) -> None:
        if not self.fs.rename(self.at(), self.jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"{self.path} cannot become {target}")


def inventory_hash(records: DataFrame, leaf_rows: int = 4096) -> str:
    """The digest of the sorted canonical JSON of all records, whatever order and files they are stored in.

    Beyond ``leaf_rows`` records it is that of a tree: records are dealt by their digests to groups of about so many, and the digests
    of the groups are treated as records again, so that no task holds more than a group. The tree depends on the records alone.
    """
    texts = records.select(canonical_row(*records.columns).alias("j"))
    n = texts.count()
    while n > leaf_rows:
        groups = 1 << (-(-n // leaf_rows) - 1).bit_length()
        group = F.pmod(F.conv(F.substring(digest(F.col("j")), 1, 8), 16, 10).cast("long"), F.lit(groups))
        texts = checkpointed(texts.groupBy(group.alias("g")).agg(sorted_digest(F.col("j")).alias("d")).select(canonical_row("g", "d").alias("j")))
        n = texts.count()
    return texts.agg(sorted_digest(F.col("j")).alias("d")).first()["d"]


RENAME_ATTEMPTS, RENAME_WAIT = 8, 0.05  # as another process may hold a file for a moment; each wait is twice the one before


def publish(staging: Folder, path: str, wait=time.sleep) -> None:
    """Renames the staging folder; where that keeps failing, copies it with the manifest last, checks the copy and then deletes it."""
    for attempt in range(RENAME_ATTEMPTS):
        try:
            return staging.rename_to(path)
        except Exception:  # noqa: BLE001  a file system's own errors come through the gateway
            if Folder(staging.spark, path).exists():
                raise
            if attempt < RENAME_ATTEMPTS - 1:
                wait(RENAME_WAIT * 2**attempt)
    target = Folder(staging.spark, path)
    conf, files = staging.spark.sparkContext._jsc.hadoopConfiguration(), staging.jvm.org.apache.hadoop.fs.FileUtil
    try:
        target.fs.mkdirs(target.at())
        for status in staging.fs.listStatus(staging.at()):
            name = status.getPath().getName()
            if name != "manifest.json":
                files.copy(staging.fs, status.getPath(), target.fs, target.at(name), False, conf)
        manifest = staging.read_text("manifest.json")
        problems = checksum_issues(staging.spark, target, json.loads(manifest))
        if problems:
            raise OSError("; ".join(problems))
        target.write_text("manifest.json", manifest)
    except Exception:
        target.fs.delete(target.at(), True)
        raise
    staging.fs.delete(staging.at(), True)


def checksum_issues(spark: SparkSession, folder: Folder, manifest: dict) -> list[str]:
    """Kinds whose records are missing or not those that were written."""
    issues = []
    for kind, expected in manifest["checksums"].items():
        if not folder.exists(kind):
            issues.append(f"{kind}: missing")
        elif inventory_hash(spark.read.parquet(f"{folder.path}/{kind}")) != expected:
            issues.append(f"{kind}: mismatch")
    return issues


def write_snapshot(path: str, tables: dict[str, DataFrame], manifest: dict, blobs: DataFrame | None = None) -> dict:
    """Writes pages, notes and errors, and blobs (sha256, content) once each; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    if Folder(spark, path).exists():
        raise FileExistsError(path)
    staging = Folder(spark, f"{path}.staging")
    checks, counts = {}, {}
    for kind, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{staging.path}/{kind}")
        stored = spark.read.parquet(f"{staging.path}/{kind}")
        counts[kind] = stored.count()
        if kind != "errors":  # errors and times are no part of what was found
            checks[kind] = inventory_hash(stored)
    if blobs is not None:
        blobs.dropDuplicates(["sha256"]).write.parquet(f"{staging.path}/blobs")
    whole = manifest | {
        "snapshot_schema_version": SCHEMA_VERSION, "record_counts": counts, "checksums": checks,
        "coverage_status": "partial" if counts.get("errors") else "complete",
    }
    staging.write_text("manifest.json", json.dumps(whole, sort_keys=True))
    publish(staging, path)
    return whole


class Snapshot:
    """A published snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)
        if not self.folder.exists("manifest.json"):
            raise FileNotFoundError(f"{path} has no manifest")
        self.manifest = json.loads(self.folder.read_text("manifest.json"))
        if self.manifest["snapshot_schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"schema version {self.manifest['snapshot_schema_version']} is not known")

    def table(self, kind: str, record_id: str | None = None) -> DataFrame:
        """Records of a kind, with ``ord`` if the id column is named."""
        df = self.folder.spark.read.parquet(f"{self.folder.path}/{kind}")
        return df.withColumn("ord", record_order(F.col(record_id))) if record_id else df

    def checksum_issues(self) -> list[str]:
        return checksum_issues(self.folder.spark, self.folder, self.manifest)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records kept as one JSON file each; malformed files fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def check_columns(df: DataFrame, expected: str) -> None:
    """Refuses columns that the schema does not have."""
    from pyspark.sql.types import StructType

    known = set(StructType.fromDDL(expected).names)
    extra = [c for c in df.columns if c not in known]
    if extra:
        raise ValueError(f"unknown columns: {extra}")


def raw_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def file_checks(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, status (ok, missing, mismatch) of expected(name, sha256) against files(name, content)."""
    actual = files.select("name", F.sha2("content", 256).alias("_a"))
    status: Column = F.when(F.col("_a").isNull(), "missing").when(F.col("_a") != F.col("sha256"), "mismatch").otherwise("ok")
    return expected.join(actual, "name", "left").select("name", status.alias("status"))


def not_yet_captured(listed: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Resuming: what an earlier run has staged is not captured again."""
    return listed.join(staged.select(key).distinct(), key, "left_anti")
