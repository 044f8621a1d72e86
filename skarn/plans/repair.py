"""A plan to restore single pages: one action for each page with a recoverable finding."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.hashing import digest
from skarn.normalize import render
from skarn.operators import selection

#: Findings that a copy of the page repairs (fixed values).
RECOVERABLE = ("source-page-missing", "empty-body", "truncated-text")


def actions(findings: DataFrame, snapshot_id: str, include_drift: bool = False) -> DataFrame:
    """action_id, source_page_id, target_note_id, kind, reason: the first finding of each page, by kind and then by note."""
    some = findings.where(F.col("kind").isin(*RECOVERABLE) & F.col("source_page_id").isNotNull())
    if not include_drift:
        some = some.where("cause <> 'source-drift'")
    chosen = selection.keep_first(some.select("source_page_id", "target_note_id", "kind", "explanation"), ["source_page_id"], [F.col("kind"), F.coalesce("target_note_id", F.lit(""))])
    action = F.substring(digest(F.concat_ws("|", F.lit(snapshot_id), "source_page_id", F.lit("recovery"))), 1, 16)
    return chosen.select(action.alias("action_id"), "source_page_id", "target_note_id", "kind", F.concat_ws(": ", "kind", "explanation").alias("reason"))


def body(tree: dict, warnings: list[str], origin: str, action_id: str) -> str:
    """The page as HTML below a banner that tells where it comes from."""
    notes = "".join(f"<li>{escape(w)}</li>" for w in warnings)
    listed = f"<ul>{notes}</ul>" if notes else ""
    return f"<blockquote><p>Recovered from {escape(origin)}</p>{listed}</blockquote>{render.render(tree)}<p>skarn:action={escape(action_id)}</p>"
