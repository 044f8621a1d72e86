"""Reports as CSV, JSON and HTML: all rows, rendered by the executors.

A report of one file is streamed: the driver passes rows on, one partition at a time, and holds none of them.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.markup import escape_html
from skarn.sources.snapshot import Folder

PREVIEW = 400  # characters of a cell

#: The reports and the kinds of finding in them (fixed values).
FINDING_REPORTS = {
    "missing-pages": ("source-page-missing",), "empty-or-truncated": ("empty-body", "truncated-text"),
    "missing-resources": ("missing-images", "missing-attachments", "resource-hash-mismatch", "broken-resource-reference"),
    "format-differences": ("representation-only", "format-conversion-loss", "unsupported-content", "lost-hierarchy"), "source-drift": ("source-drift",),
}


def path_text(path: Column) -> Column:
    return F.coalesce(F.array_join(path, " / "), F.lit(""))


def with_names(matches: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Matches with source_title, source_path, target_title and target_path."""
    a = pages.select(F.col("id").alias("source_page_id"), F.col("page_title").alias("source_title"), F.col("path").alias("source_path"))
    b = notes.select(F.col("id").alias("target_note_id"), F.col("title").alias("target_title"), F.col("path").alias("target_path"))
    return matches.join(a, "source_page_id", "left").join(b, "target_note_id", "left")


def match_rows(matches: DataFrame) -> DataFrame:
    """Matches with texts only, as CSV takes them."""
    def score(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("")

    def told(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in matches.columns else F.lit("")

    def path(c: str) -> Column:
        return path_text(F.col(c)) if c in matches.columns else F.lit("")

    return matches.select(
        told("source_page_id").alias("source_page_id"), told("target_note_id").alias("target_note_id"), "confidence", "stage", score("score").alias("score"),
        score("margin").alias("runner_up_margin"), told("source_title").alias("source_title"), path("source_path").alias("source_path"),
        told("target_title").alias("target_title"), path("target_path").alias("target_path"), F.coalesce(F.array_join("explanation", " | "), F.lit("")).alias("explanation"),
    )


def finding_rows(findings: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source_page_id", "target_note_id", "title")]
    return findings.select("kind", "evidence", "cause", *texts, path_text(F.col("path")).alias("path"), "explanation")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_reports(matches: DataFrame, findings: DataFrame, path: str) -> None:
    """Folders of CSV files: matches, ambiguous ones, and the findings of each report; ``findings`` has all of them."""
    write_csv(match_rows(matches), f"{path}/matches")
    write_csv(match_rows(matches.where("confidence = 'ambiguous'")), f"{path}/ambiguous")
    write_csv(finding_rows(findings), f"{path}/findings")
    for name, kinds in FINDING_REPORTS.items():
        write_csv(finding_rows(findings.where(F.col("kind").isin(*kinds))), f"{path}/{name}")


def extractor_errors(source: DataFrame, target: DataFrame) -> DataFrame:
    """Errors of both scans, with the snapshot that they are of."""
    columns = ["scope", "item_id", "item_title", "exception_type", "message"]
    return source.select(F.lit("source").alias("snapshot"), *columns).unionByName(target.select(F.lit("target").alias("snapshot"), *columns))


def summary(matches: DataFrame, findings: DataFrame) -> dict:
    """Counts by confidence, kind, evidence and cause; a few rows each."""
    from skarn.plans.audit import count_by_each

    out = {"confidence": {r["confidence"]: r["count"] for r in matches.where("source_page_id is not null").groupBy("confidence").count().collect()}}
    names = ["kind", "evidence", "cause"]
    for r in count_by_each(findings.select(*names), names).collect():
        name = names[r["grouping_id"] - 1]
        out.setdefault(name, {})[r[name]] = r["n"]
    return out


def escaped(value: Column) -> Column:
    return escape_html(F.coalesce(value.cast("string"), F.lit("")), attribute=True)


def preview(value: Column) -> Column:
    """The first ``PREVIEW`` characters of a cell."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return escaped(F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("…"))).otherwise(text))


def html_rows(df: DataFrame, facets: list[str], path: Column, cells: list[Column]) -> DataFrame:
    """One HTML row a row, with what the filters look at; in the order of its first columns."""
    marks = [F.concat(F.lit(f' data-{f}="'), escaped(F.col(f)), F.lit('"')) for f in facets]
    marks.append(F.concat(F.lit(' data-path="'), escaped(F.lower(path)), F.lit('"')))
    told = [F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells]
    return df.select(F.concat(F.lit("<tr"), *marks, F.lit(">"), *told, F.lit("</tr>\n")).alias("row"))


SCRIPT = """<script>
function sift(table) {
  const wanted = [...document.querySelectorAll(`[data-for="${table}"]`)].map(c => [c.name, c.value.toLowerCase()]);
  for (const row of document.querySelectorAll(`#${table} tbody tr`))
    row.hidden = !wanted.every(([name, value]) => !value || (name === 'path' ? row.dataset.path.includes(value) : row.dataset[name] === value));
}
</script>"""


def filters(table: str, facets: dict[str, Iterable[str]]) -> str:
    """A choice for each facet and a field for paths."""
    out = ""
    for name, values in facets.items():
        options = "".join(f"<option>{html.escape(str(v))}</option>" for v in sorted(map(str, values)))
        out += f'<label>{name} <select name="{name}" data-for="{table}" onchange="sift(\'{table}\')"><option value="">all</option>{options}</select></label> '
    return out + f'<label>path <input name="path" data-for="{table}" oninput="sift(\'{table}\')"></label>'


def html_parts(title: str, counts: dict, matches: DataFrame, findings: DataFrame) -> Iterator[str]:
    """The page in pieces: counts, all findings, all matches, and filters over both."""
    name = html.escape(title)
    yield f"<!doctype html><meta charset=utf-8><title>{name}</title><h1>{name}</h1>"
    for k, c in counts.items():
        yield f"<h2>{html.escape(k)}</h2><ul>" + "".join(f"<li>{html.escape(str(n))}: {html.escape(str(v))}</li>" for n, v in sorted(c.items(), key=str)) + "</ul>"

    def table(key: str, heads: list[str], rows: DataFrame) -> Iterator[str]:
        yield f'<table id="{key}"><thead><tr>{"".join(f"<th>{h}</th>" for h in heads)}</tr></thead><tbody>\n'
        for row in rows.toLocalIterator():
            yield row["row"]
        yield "</tbody></table>"

    yield "<h2>Findings</h2>" + filters("findings", {k: counts.get(k, {}) for k in ("kind", "evidence", "cause")})
    ids = F.concat_ws(" ", "source_page_id", "target_note_id")
    details = F.when(F.size("details") > 0, F.concat(F.lit('<div class="details">'), preview(F.to_json("details")), F.lit("</div>"))).otherwise("")
    cells = [escaped(F.col(c)) for c in ("kind", "evidence", "cause", "title")] + [escaped(path_text(F.col("path"))), F.concat(preview(F.col("explanation")), details), escaped(ids)]
    ordered = findings.orderBy("kind", "source_page_id", "target_note_id")
    yield from table("findings", ["kind", "evidence", "cause", "title", "path", "explanation", "ids"], html_rows(ordered, ["kind", "evidence", "cause"], path_text(F.col("path")), cells))
    told = match_rows(matches)
    yield "<h2>Matches</h2>" + filters("matches", {"confidence": counts.get("confidence", {})})
    both = F.concat_ws(" ", "source_path", "target_path")
    sides = [F.concat(escaped(F.col(f"{s}_title")), F.lit(" — "), escaped(F.col(f"{s}_path"))) for s in ("source", "target")]
    rows = html_rows(told.orderBy("source_page_id", "target_note_id"), ["confidence"], both, [escaped(F.col(c)) for c in ("confidence", "stage", "score")] + [*sides, preview(F.col("explanation"))])
    yield from table("matches", ["confidence", "stage", "score", "source", "target", "explanation"], rows)
    yield SCRIPT


def json_parts(counts: dict, matches: DataFrame, findings: DataFrame) -> Iterator[str]:
    """The whole result as one JSON object: summary, matches, findings."""
    yield '{"summary":' + json.dumps(counts, ensure_ascii=False, sort_keys=True)
    for name, df in (("matches", matches), ("findings", findings)):
        yield f',"{name}":['
        for k, row in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            yield (",\n" if k else "\n") + row["j"]
        yield "]"
    yield "}\n"


def write_whole(folder: Folder, title: str, counts: dict, matches: DataFrame, findings: DataFrame) -> None:
    """``report.html`` and ``report.json``."""
    folder.write_parts("report.html", html_parts(title, counts, matches, findings))
    folder.write_parts("report.json", json_parts(counts, matches, findings))


def write_operations(operations: DataFrame, path: str) -> None:
    """The ordered operations of a dry run as JSON lines."""
    operations.orderBy("place").write.json(path)
