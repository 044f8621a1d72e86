"""Scans of source collections: file listings, hierarchies, exclusion lists and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from skarn.functions.markup import logical_title, resource_refs
from skarn.operators.selection import latest_per_key

PAGE_ROW = StructType(
    [StructField(n, StringType()) for n in ("notebook_id", "notebook_title", "section_id", "section_title")]
    + [StructField("groups", ArrayType(StringType())), StructField("page_id", StringType()), StructField("page_title", StringType())]
    + [StructField(n, IntegerType()) for n in ("page_level", "page_order")]
    + [StructField(n, StringType()) for n in ("created_at", "updated_at")] + [StructField("in_recycle_bin", BooleanType())]
)


@pandas_udf(ArrayType(PAGE_ROW))
def hierarchy_rows(xml):
    from skarn.normalize.pagexml import hierarchy

    return xml.map(lambda x: None if x is None else hierarchy(x))


def hierarchy_pages(documents: DataFrame, xml: str) -> DataFrame:
    """One row a page of hierarchy documents."""
    return documents.select(F.explode(hierarchy_rows(F.col(xml))).alias("_p")).select("_p.*")


def without_excluded(pages: DataFrame, excluded: DataFrame, notebooks: list[str] | None = None, recycle_bin: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages to capture, and counts: excluded ids that met a page, and those that met none.

    ``excluded(page_id)`` holds distinct exact ids; a repeated one is refused.
    """
    if excluded.groupBy("page_id").count().where("count > 1").limit(1).count():
        raise ValueError("an excluded id is listed twice")
    scope = pages if recycle_bin else pages.where(~F.col("in_recycle_bin"))
    if notebooks:
        scope = scope.where(F.col("notebook_title").isin(notebooks))
    met = scope.select("page_id", F.lit(True).alias("_met")).distinct()
    counts = excluded.join(met, "page_id", "left").agg(F.count_if("_met").alias("n_excluded"), F.count_if(F.col("_met").isNull()).alias("n_stale"))
    return scope.join(excluded, "page_id", "left_anti"), counts


def latest_sections(files: DataFrame, key: Column, stem: Column) -> DataFrame:
    """The newest file of each logical section, and how many older ones it has."""
    told = files.select(F.lower(key).alias("section_key"), logical_title(stem).alias("title"), "path", "modified")
    return latest_per_key(told, ["section_key"], [F.col("modified"), F.col("path")])


def best_root(files: DataFrame, root: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The folder with most dated files, then most files, version, newest file and name; one of all, or of each group ``within``."""
    scored = files.groupBy(*within, root).agg(
        F.count_if("dated").alias("n_dated"), F.count("*").alias("n_files"), F.max("version").alias("version"), F.max("modified").alias("newest")
    )
    told = [c for c in scored.columns if c not in within]
    return scored.groupBy(*within).agg(F.max_by(F.struct(*told), F.struct("n_dated", "n_files", "version", "newest", root)).alias("b")).select(*within, "b.*")


def referenced_resources(notes: DataFrame, attached: DataFrame) -> DataFrame:
    """note_id, ref, status: attached resources, and those that a body refers to but that are missing."""
    refs = notes.select("note_id", F.explode(resource_refs(F.col("body"))).alias("ref"))
    return refs.withColumn("_r", F.lit(True)).join(attached.select("note_id", "ref").distinct().withColumn("_a", F.lit(True)), ["note_id", "ref"], "full_outer").select(
        "note_id", "ref", F.when(F.col("_a").isNull(), "missing").otherwise("ok").alias("status"), F.coalesce("_r", F.lit(False)).alias("referenced")
    )


def note_status(deleted_ms: Column, conflict: Column, parent_trashed: Column) -> Column:
    return F.when((F.coalesce(deleted_ms, F.lit(0)) > 0) | F.coalesce(parent_trashed, F.lit(False)), "trashed").when(F.coalesce(conflict, F.lit(0)) == 1, "conflict").otherwise("normal")


RESOURCE_ROW = StructType(
    [StructField("place", IntegerType())] + [StructField(n, StringType()) for n in ("reference", "kind", "name", "data")]
)


@pandas_udf(ArrayType(RESOURCE_ROW))
def html_resources(body):
    """Images and objects of HTML bodies in document order, full-size URLs first, each URL once."""
    from skarn.normalize.html import build

    def one(text):
        seen: dict[str, tuple] = {}
        for element in build(text or "").find_all("img", "object"):
            a = element.attrs
            url = a.get("data-fullres-src") or a.get("src") or a.get("data") or ""
            if url and url not in seen:
                image = element.name == "img"
                seen[url] = ("image" if image else "file", a.get("alt" if image else "data-attachment", ""))
        return [{"place": k, "reference": u, "kind": kind, "name": name, "data": None} for k, (u, (kind, name)) in enumerate(seen.items())]

    return body.map(one)


@pandas_udf(ArrayType(RESOURCE_ROW))
def page_resources(xml):
    """Images (with their base64 data) and files of page XML, referred to as ``image:N`` and ``file:N``."""
    import xml.etree.ElementTree as ET

    from skarn.normalize.pagexml import children, local, references

    def one(text):
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return []
        refs, out = references(root), []
        for element in root.iter():
            if id(element) in refs:
                image = local(element) == "Image"
                data = next((d.text for d in children(element, "Data")), None)
                name = element.attrib.get("alt" if image else "preferredName", "")
                out.append({"place": len(out), "reference": refs[id(element)], "kind": "image" if image else "file", "name": name, "data": data})
        return out

    return xml.map(one)


@pandas_udf(ArrayType(StringType()))
def page_warnings(xml):
    """What page XML holds that has no form in the target: "unsupported OneNote object: KIND xN"."""
    import xml.etree.ElementTree as ET
    from collections import Counter

    from skarn.normalize.pagexml import PLACEHOLDERS, local

    def one(text):
        try:
            kinds = Counter(local(e) for e in ET.fromstring(text or "").iter())
        except ET.ParseError:
            return []
        return [f"unsupported OneNote object: {k} x{kinds[k]}" for k in sorted(PLACEHOLDERS) if kinds[k]]

    return xml.map(one)


def resources_of(df: DataFrame, key: str, found: Column) -> DataFrame:
    """One row a resource, with the digest of data that came inline."""
    rows = df.select(key, F.explode(found).alias("_r")).select(key, "_r.*")
    return rows.withColumn("content", F.unbase64("data")).withColumn("sha256", F.sha2("content", 256)).drop("data")
