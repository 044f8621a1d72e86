"""JSON Schemas of everything that is stored, made from the schemas that the code reads and writes with."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructType,
)

from skarn.plans.detect import FINDING
from skarn.sources.snapshot import ERROR, NOTE, PAGE, Folder

MATCH = (
    "source_page_id string, target_note_id string, confidence string, stage string, score double, margin double, features map<string,double>, "
    "explanation array<string>, source_title string, source_path array<string>, target_title string, target_path array<string>"
)
COUNTS = "map<string,bigint>"
PLAN = (
    "export_plan_schema_version int, tool_version string, created_at_utc string, plan_id string, conflict_policy string, source_snapshot_id string, "
    "source_inventory_hash string, source_manifest_hash string, target_instance_fingerprint string, content_mode string, n_folders bigint, n_notes bigint, tables map<string,string>"
)
FORMATS = {
    "page-record": PAGE, "note-record": NOTE, "error-record": ERROR,
    "manifest": f"snapshot_schema_version int, snapshot_id string, source_backend string, audit_role string, tool_version string, scan_started_at_utc string, "
    f"scan_finished_at_utc string, configuration map<string,string>, record_counts {COUNTS}, checksums map<string,string>, coverage_status string, coverage_notes array<string>",
    "match-result": MATCH, "finding": FINDING,
    "audit-result": f"summary map<string,{COUNTS}>",
    "export-plan": PLAN,
    "export-folder": "folder_id string, parent_id string, title string, kind string, level int, source_key string",
    "export-note": "action_id string, source_page_id string, folder_id string, title string, body_sha256 string, semantic_sha256 string, resource_hashes array<string>, "
    "created_at string, updated_at string, page_order int, place bigint",
    "export-body": "action_id string, body string",
    "export-approval": "export_approval_schema_version int, export_plan_sha256 string, operator string, note string",
    "export-dry-run-receipt": "export_receipt_schema_version int, plan_id string, export_plan_sha256 string, approval_sha256 string, target_instance_fingerprint string, "
    "live_folder_count bigint, live_note_count bigint, live_resource_count bigint, live_precondition_fingerprint string, result string, problems array<string>, mutating_requests_sent int",
    "export-operation": "place bigint, phase int, kind string, subject string",
    "export-validation-issue": "kind string, id string, expected string, actual string",
    "repair-action": "action_id string, source_page_id string, target_note_id string, kind string, reason string",
    "exclusion": "page_id string",
    "target-folder": "id string, parent_id string, title string, user_data string, deleted_time bigint",
    "target-resource": "id string, sha256 string, title string, mime string, size bigint",
}
SIMPLE = {StringType: "string", BooleanType: "boolean", IntegerType: "integer", LongType: "integer", DoubleType: "number", FloatType: "number", BinaryType: "string"}


def json_schema(kind: DataType, nullable: bool = True) -> dict:
    """The JSON Schema of a type; objects allow no fields beyond theirs."""
    if isinstance(kind, StructType):
        out = {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    else:
        out = {"type": SIMPLE[type(kind)]}
    return out | {"type": [out["type"], "null"]} if nullable else out


def json_schemas() -> dict[str, dict]:
    """name: JSON Schema of each stored format."""
    found = {}
    for name, ddl in FORMATS.items():
        found[name] = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name} | json_schema(StructType.fromDDL(ddl), nullable=False)
    whole = found["audit-result"]["properties"]
    for part, name in (("matches", "match-result"), ("findings", "finding")):
        whole[part] = {"type": "array", "items": json_schema(StructType.fromDDL(FORMATS[name]), nullable=False)}
    return found


def write_schemas(spark: SparkSession, path: str) -> list[str]:
    """Writes ``NAME.schema.json`` for each; returns the names."""
    folder, found = Folder(spark, path), json_schemas()
    for name, schema in found.items():
        folder.write_text(f"{name}.schema.json", json.dumps(schema, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return sorted(found)
