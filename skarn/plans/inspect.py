"""What a target holds before an export: managed roots, staging leftovers, and rows nobody owns.

Folders carry a marker: JSON in ``user_data`` with plan_id, folder_id and state. All checks are joins over
listings; nothing is changed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.hashing import canonical_json
from skarn.operators.trees import subtree


def marker(field: str, column: str = "user_data", key: str = "export") -> Column:
    return F.get_json_object(column, f"$.{key}.{field}")


def root_states(folders: DataFrame, plan_id: str) -> DataFrame:
    """Root folders as current, old (another plan's, published), foreign-staging or unmanaged."""
    own, state = marker("plan_id"), marker("state")
    kind = (
        F.when(own.isNull(), "unmanaged").when(own == plan_id, "current")
        .when(state == "staging", "foreign-staging").otherwise("old")
    )
    roots = folders.where(F.coalesce("parent_id", F.lit("")) == "")
    return roots.select("id", "title", own.alias("plan_id"), state.alias("state"), kind.alias("kind"))


def managed(folders: DataFrame) -> DataFrame:
    """All folders under a marked root, the root included."""
    roots = folders.where((F.coalesce("parent_id", F.lit("")) == "") & marker("plan_id").isNotNull())
    return subtree(folders, roots.select("id")).select("id").distinct()


def ownership_problems(folders: DataFrame, notes: DataFrame, resources: DataFrame, planned: DataFrame) -> DataFrame:
    """kind, id of what a managed profile must not hold: folders without marker, notes outside managed
    folders or not of the plan, resources that no note refers to."""
    inside = managed(folders)
    unmarked = folders.where(marker("plan_id").isNull()).select(F.lit("folder-without-marker").alias("kind"), "id")
    orphan = notes.join(inside.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("note-outside-managed-folders").alias("kind"), "id")
    foreign = notes.join(planned.select("source_url").distinct(), "source_url", "left_anti").select(F.lit("note-not-of-the-plan").alias("kind"), "id")
    used = notes.select(F.explode("resource_ids").alias("id")).distinct()
    loose = resources.join(used, "id", "left_anti").select(F.lit("unmarked-resource").alias("kind"), "id")
    return unmarked.unionByName(orphan).unionByName(foreign).unionByName(loose)


def plan_state(planned: DataFrame, folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Planned folders and notes against what is there: present, missing or duplicate."""
    there = folders.select(marker("folder_id").alias("key")).unionByName(notes.select(F.col("source_url").alias("key"))).where("key is not null")
    counts = there.groupBy("key").agg(F.count("*").alias("n"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "duplicate").otherwise("present")
    return planned.join(counts, "key", "left").select("key", state.alias("state"))


def profile_counts(folders: DataFrame, notes: DataFrame, resources: DataFrame) -> dict[str, int]:
    return {"folder": folders.count(), "note": notes.count(), "resource": resources.count()}


def record_counts(records: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: ``n`` records, and how many meet each named condition, in one pass."""
    return records.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def observations_fingerprint(observations: DataFrame, column: str) -> str:
    """A digest of a set of texts that does not depend on their order, added up on the executors."""
    row = F.sha2(column, 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    total = observations.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(canonical_json([str(x) for x in total]).encode()).hexdigest()


def instance_fingerprint(folders: DataFrame) -> str:
    """Of all folders but the managed ones: tells one profile from another, before and after an export."""
    return observations_fingerprint(folders.join(managed(folders), "id", "left_anti"), "id")[:16]
