"""Queries over plans, ownership, findings and page resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import hashing
from skarn.operators import features, selection
from skarn.operators.multisets import set_differences
from skarn.plans import detect, export, inspect
from skarn.plans.registry import query
from skarn.plans.tables import table


@query(
    """SELECT substr(sha256('snap|' || page || '|full-export'), 1, 16) AS action_id, page, row_number() OVER (ORDER BY source, lang, section, n_chars, page) AS place
      FROM (SELECT 'd' || doc_id AS page, lower(source) AS source, lower(lang) AS lang, CAST(n_chars % 7 AS VARCHAR) AS section, n_chars FROM documents)"""
)
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action ids and the total order of pages."""
    pages = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("source_page_id"), F.col("source").alias("notebook_title"), F.array("lang").alias("section_group_path"),
        (F.col("n_chars") % 7).cast("string").alias("section_title"), F.col("n_chars").alias("page_order"),
    )
    ranked = selection.global_rank(pages, export.page_order())
    return ranked.select(export.short_id(F.lit("snap"), F.col("source_page_id"), F.lit("full-export")).alias("action_id"), F.col("source_page_id").alias("page"), "place")


@query(
    """SELECT kind, id FROM (
      SELECT 'folder-without-marker' AS kind, 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0
      UNION ALL SELECT 'note-outside-managed-folders', 'c' || c_custkey FROM customer WHERE c_nationkey % 5 = 0
      UNION ALL SELECT 'note-not-of-the-plan', 'c' || c_custkey FROM customer WHERE c_custkey % 13 = 0
      UNION ALL SELECT 'unmarked-resource', 'p' || p_partkey FROM part WHERE p_partkey % 7 = 0)"""
)
def ownership_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, notes and resources that a managed profile must not hold."""
    nation, customer, part = (table(spark, sf_dir, t) for t in ("nation", "customer", "part"))
    mark = F.when(F.col("n_nationkey") % 5 != 0, F.lit('{"export":{"plan_id":"p","state":"published"}}'))
    folders = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("").alias("parent_id"), mark.alias("user_data"))
    # each part belongs to one customer, so that resources are a few a note
    used = part.where("p_partkey % 7 <> 0").select(F.floor(F.col("p_partkey") * 0.75).alias("k"), F.concat(F.lit("p"), "p_partkey").alias("r")).groupBy("k").agg(F.collect_list("r").alias("resource_ids"))
    notes = customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("source_url"), F.col("c_custkey").alias("k")
    ).join(used, "k", "left").withColumn("resource_ids", F.coalesce("resource_ids", F.array().cast("array<string>")))
    planned = customer.where("c_custkey % 13 <> 0").select(F.col("c_name").alias("source_url"))
    return inspect.ownership_problems(folders, notes, part.select(F.concat(F.lit("p"), "p_partkey").alias("id")), planned)


@query(
    """SELECT kind, count(*) AS n FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'unmanaged' WHEN n_nationkey % 4 = 1 THEN 'current'
      WHEN n_nationkey % 4 = 2 THEN 'foreign-staging' ELSE 'old' END AS kind FROM nation) GROUP BY kind"""
)
def root_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root folders by what their markers say."""
    k = F.col("n_nationkey") % 4
    mark = F.when(k == 1, '{"export":{"plan_id":"p","state":"staging"}}').when(k == 2, '{"export":{"plan_id":"q","state":"staging"}}').when(k == 3, '{"export":{"plan_id":"q","state":"published"}}')
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("title"), mark.alias("user_data"))
    return inspect.root_states(folders, "p").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """SELECT status, count(*) AS n FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN 'missing' WHEN d.doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents d) GROUP BY status"""
)
def checksum_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against the digests of a manifest."""
    from skarn.sources.snapshot import file_checks

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    expected = docs.select("name", F.when(F.col("name") % 5 == 0, F.lit("other")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return file_checks(docs.where("name % 9 <> 0"), expected).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, CAST(CASE WHEN target = source THEN 1.0 WHEN c_custkey % 4 = 1 THEN 0.8 WHEN list_contains(target, source[1]) THEN 0.4 ELSE 0.0 END AS DOUBLE) AS path,
      round(CAST(least(a, b) AS DOUBLE) / greatest(a, b), 6) AS counts, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS level FROM (
      SELECT c_custkey, [c_mktsegment, 'x'] AS source, CASE c_custkey % 4 WHEN 0 THEN [c_mktsegment, 'x'] WHEN 1 THEN ['root', c_mktsegment, 'x'] WHEN 2 THEN ['z', c_mktsegment] ELSE [] END AS target,
        1.0 + c_custkey % 5 AS a, 1.0 + c_nationkey % 3 AS b FROM customer)"""
)
def path_and_count_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of paths and of counts, and the level feature."""
    customer = table(spark, sf_dir, "customer")
    c, seg = F.col("c_custkey"), F.col("c_mktsegment")
    source = F.array(seg, F.lit("x"))
    target = F.when(c % 4 == 0, source).when(c % 4 == 1, F.array(F.lit("root"), seg, F.lit("x"))).when(c % 4 == 2, F.array(F.lit("z"), seg)).otherwise(F.array().cast("array<string>"))
    counts = features.count_similarity((1.0 + c % 5, 1.0 + F.col("c_nationkey") % 3))
    return customer.select(
        "c_custkey", F.round(features.path_similarity(source, target), 6).alias("path"), F.round(counts, 6).alias("counts"),
        features.level_feature(1 + c % 2).alias("level"),
    )


@query(
    """WITH p AS (SELECT a.doc_id AS pid, b.doc_id AS nid, length(a.text) AS pl, length(b.text) AS nl, a.text = b.text AS same, a.source <> b.source AS moved, a.doc_id % 6 = 0 AS drift
      FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0 AND a.text IS NOT NULL AND b.text IS NOT NULL)
    SELECT kind, evidence, cause, count(*) AS n FROM (
      SELECT 'source-drift' AS kind, 'informational' AS evidence, 'source-drift' AS cause FROM p WHERE drift
      UNION ALL SELECT 'truncated-text', CASE WHEN drift THEN 'uncertain' ELSE 'probable' END, CASE WHEN drift THEN 'source-drift' ELSE 'migration-loss' END FROM p WHERE nl > 0 AND pl - nl >= 100 AND pl - nl >= 0.3 * pl
      UNION ALL SELECT 'semantic-difference', CASE WHEN drift THEN 'uncertain' ELSE 'probable' END, CASE WHEN drift THEN 'source-drift' ELSE 'migration-loss' END FROM p WHERE NOT same
      UNION ALL SELECT 'empty-body', CASE WHEN drift THEN 'uncertain' ELSE 'confirmed' END, CASE WHEN drift THEN 'source-drift' ELSE 'migration-loss' END FROM p WHERE pl > 0 AND nl = 0
      UNION ALL SELECT 'wrong-placement', 'informational', 'migration-loss' FROM p WHERE moved
      UNION ALL SELECT 'lost-hierarchy', 'informational', 'format-conversion' FROM p WHERE pid % 10 = 0
      UNION ALL SELECT 'lost-timestamps', 'confirmed', 'migration-loss' FROM p WHERE pid % 14 = 0
      UNION ALL SELECT 'representation-only', 'informational', 'format-conversion' FROM p WHERE same AND pid % 4 = 0) GROUP BY ALL"""
)
def pair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of linked pairs over neighbouring documents, counted."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source", hashing.digest(F.col("text")).alias("digest"))
    a, b = docs.where("doc_id % 2 = 0").alias("a"), docs.alias("b")
    pid = F.col("a.doc_id")
    none = F.array().cast("array<string>")
    same_on_both = {
        "image_count": F.lit(0), "attachment_count": F.lit(0), "image_hashes": none, "attachment_hashes": none, "normalizer_version": F.lit("1"),
        "missing_resources": F.lit(0), "placeholder": F.lit(False), "title": F.lit("t"), "warnings": none,
    }
    pairs = a.join(b, F.col("b.doc_id") == pid + 1).select(
        pid.cast("string").alias("source_page_id"), F.col("b.doc_id").cast("string").alias("target_note_id"),
        *[v.alias(f"{side}_{k}") for side in "pn" for k, v in same_on_both.items()],
        F.col("a.text").alias("p_text"), F.col("b.text").alias("n_text"), F.col("a.digest").alias("p_semantic_sha256"), F.col("b.digest").alias("n_semantic_sha256"),
        F.when(pid % 4 == 0, "html").otherwise("markdown").alias("p_format"), F.lit("markdown").alias("n_format"),
        F.array("a.source").alias("p_path"), F.array("b.source").alias("n_path"), F.when(pid % 10 == 0, 2).otherwise(1).alias("p_level"),
        F.lit(0.0).alias("n_created_s"), F.when(pid % 14 == 0, 1e6).otherwise(0.0).alias("p_created_s"), F.when(pid % 6 == 0, 86402.0).otherwise(86401.0).alias("p_updated_s"),
    )
    return detect.pair_findings(pairs, 1.0).groupBy("kind", "evidence", "cause").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1"""
)
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    first = selection.keep_first(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    """SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_totalprice > 150000) AS n_large FROM orders"""
)
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status in one pass."""
    status = F.col("o_orderstatus")
    return inspect.record_counts(table(spark, sf_dir, "orders"), {"n_done": status == "F", "n_open": status == "O", "n_large": F.col("o_totalprice") > 150_000})


@query()
def html_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and objects of pages."""
    from skarn.sources.scans import html_resources as found

    body = F.concat("html", F.lit('<img src="/a.png" data-fullres-src="/full.png" alt="A"><object data="/f.pdf" data-attachment="f.pdf"></object><img src="/full.png">'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found(body)).alias("r")).select("page_id", "r.place", "r.reference", "r.kind", "r.name")


@query(
    """SELECT l_orderkey, n_left, n_right, n_common FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_left, count(*) FILTER (l_returnflag <> 'R') AS n_right,
      len(list_intersect(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R'))) AS n_common FROM lineitem GROUP BY l_orderkey) WHERE n_left > 0 AND n_right > 0"""
)
def shared_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that two states of an order share."""
    left = F.col("l_returnflag") == "R"
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"), F.collect_set(F.when(left, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(~left, F.col("l_suppkey"))).alias("b")
    ).where("n_left > 0 and n_right > 0")
    return sets.select("l_orderkey", "n_left", "n_right", F.size(set_differences(F.col("a"), F.col("b"))[2]).cast("long").alias("n_common"))
