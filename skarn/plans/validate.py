"""Checks of a migrated collection against its plan, and the guards of a plan before it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(found: DataFrame, columns: list[str]) -> DataFrame:
    """One row an id: how often it was found, and the columns of one of its rows."""
    return found.groupBy("id").agg(F.count("*").alias("n"), *[F.min(c).alias(f"found_{c}") for c in columns])


def issue(df: DataFrame, kind: str, condition: Column) -> DataFrame:
    return df.where(condition).select(F.lit(kind).alias("kind"), "id")


#: Columns that are compared, and the issue that a difference is (fixed values).
COMPARED = {
    "path": "wrong-export-path", "title": "wrong-export-title", "text_sha256": "normalized-text-mismatch",
    "resource_hashes": "resource-hash-mismatch",
}


def note_issues(planned: DataFrame, found: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """kind, id, expected, actual of every difference between planned and found notes, in one join.

    Both have ``id`` and some of path, title, text_sha256 and resource_hashes (a sorted array). A planned
    id found several times is a duplicate and not compared further; found rows without id are unexpected.
    ``source``: the ``id`` of each page that the source holds; a planned id that is not among them is that issue alone.
    """
    columns = [c for c in COMPARED if c in planned.columns and c in found.columns]
    nameless = found.where(F.col("id").isNull()).select(F.lit("unexpected-note-without-source-id").alias("kind"), "id")
    plan = planned.select("id", *[F.col(c).alias(f"planned_{c}") for c in columns], F.lit(True).alias("_planned"))
    if source is None:
        plan = plan.withColumn("_held", F.lit(True))
    else:
        plan = plan.join(source.select("id", F.lit(True).alias("_held")).distinct(), "id", "left")
    both = plan.join(grouped(found.where(F.col("id").isNotNull()), columns), "id", "full_outer")
    planned_, count = F.col("_planned").isNotNull(), F.coalesce("n", F.lit(0))
    known = planned_ & F.col("_held").isNotNull()
    kinds = [
        F.when(planned_ & F.col("_held").isNull(), "planned-source-page-missing"),
        F.when(~planned_, "unexpected-exported-source-id"), F.when(known & (count == 0), "exported-note-missing"),
        F.when(known & (count > 1), "duplicate-exported-note"),
    ]
    def told(kind: Column, expected: Column | None = None, actual: Column | None = None) -> Column:
        values = {"kind": kind, "expected": expected, "actual": actual}
        return F.when(kind.isNotNull(), F.struct(*[(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()]))

    def shown(column: str) -> Column:
        value = F.col(column)
        return F.array_join(value, " / " if column.endswith("path") else ",") if dict(both.dtypes)[column].startswith("array") else value

    kinds = [told(k) for k in kinds] + [
        told(F.when(known & (count == 1) & ~F.col(f"planned_{c}").eqNullSafe(F.col(f"found_{c}")), COMPARED[c]), shown(f"planned_{c}"), shown(f"found_{c}")) for c in columns
    ]
    issues = both.select("id", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("_i")).select("_i.kind", "id", "_i.expected", "_i.actual")
    return issues.unionByName(nameless.select("kind", "id", *[F.lit(None).cast("string").alias(c) for c in ("expected", "actual")]))


def profile_issues(counts: dict[str, int], planned: dict[str, int]) -> list[str]:
    """Of a strict profile: it holds the planned folders and notes and nothing else."""
    return [f"strict-profile-{k}-count" for k in ("folder", "note") if counts[k] != planned[k]]


def snapshot_issues(source: dict, target: dict, plan: dict) -> list[str]:
    """Of the manifests of both snapshots (snapshot_id, coverage, checksums_ok) and the plan."""
    found = []
    if source["snapshot_id"] != plan["source_snapshot_id"]:
        found.append("wrong-source-snapshot")
    found += [f"{name}-coverage-not-complete" for name, m in (("source", source), ("target", target)) if m["coverage"] != "complete"]
    found += [f"{name}-checksum" for name, m in (("source", source), ("target", target)) if not m["checksums_ok"]]
    return found
