"""Queries over hierarchies, versions, sets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import hashing
from skarn.operators import multisets, selection, trees
from skarn.plans.registry import query
from skarn.plans.tables import table
from skarn.sources import scans, snapshot


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, n - 1 AS n_skipped FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"""
)
def section_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer, and how many are older."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    found = selection.latest_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return found.select("o_custkey", "o_orderkey", "o_totalprice", "n_skipped")


@query(
    """SELECT n_regionkey, n_nationkey, dated, files FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY dated DESC, files DESC, newest DESC, n_nationkey DESC) AS k
      FROM (SELECT n_regionkey, n_nationkey, n_name, count(*) FILTER (c_mktsegment = 'BUILDING') AS dated, count(*) AS files, max(c_custkey) AS newest
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE k = 1"""
)
def root_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored folder by a tuple of counts: the largest nation of each region."""
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    files = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", "n_nationkey", (F.col("c_mktsegment") == "BUILDING").alias("dated"), F.lit(1).alias("version"), F.col("c_custkey").alias("modified")
    )
    found = scans.best_root(files, "n_nationkey", ("n_regionkey",))
    return found.select("n_regionkey", "n_nationkey", F.col("n_dated").alias("dated"), F.col("n_files").alias("files"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one adjacency list, and a ring that is its own parent."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("").alias("parent_id"), F.col("r_name").alias("title"))
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))
        .unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("title")))
        .unionByName(region.select(F.concat(F.lit("x"), "r_regionkey").alias("id"), F.concat(F.lit("x"), (F.col("r_regionkey") + 1) % 5).alias("parent_id"), F.col("r_name").alias("title")))
    )


FOLDERS = """folders AS (SELECT 'r' || r_regionkey AS id, '' AS parent_id, r_name AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'x' || r_regionkey, 'x' || ((r_regionkey + 1) % 5), r_name FROM region)"""


@query(
    f"""WITH RECURSIVE {FOLDERS}, up AS (SELECT id, parent_id AS next, [title] AS path, 1 AS hops FROM folders
      UNION ALL SELECT u.id, f.parent_id, list_prepend(f.title, u.path), hops + 1 FROM up u JOIN folders f ON f.id = u.next WHERE hops < 100)
    SELECT id, array_to_string(arg_max(path, hops), ' / ') AS path, max(hops) - 1 AS level FROM up GROUP BY id"""
)
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every folder."""
    return trees.tree_paths(folders(spark, sf_dir)).select("id", F.array_join("path", " / ").alias("path"), "level")


@query(
    f"""WITH RECURSIVE {FOLDERS}, roots AS (SELECT id AS root_id FROM folders WHERE id LIKE 'n%'),
    sub AS (SELECT root_id, root_id AS id FROM roots UNION ALL SELECT s.root_id, f.id FROM folders f JOIN sub s ON f.parent_id = s.id)
    SELECT root_id, count(*) AS n, substr(sha256(count(*) || ',' || sum(CAST('0x' || substr(sha256(id), 1, 15) AS HUGEINT))), 1, 16) AS fingerprint FROM sub GROUP BY root_id"""
)
def subtree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of the ids under each nation."""
    every = folders(spark, sf_dir)
    sub = trees.subtree(every, every.where("id like 'n%'").select("id"))
    return sub.groupBy("root_id").agg(F.count("*").alias("n"), hashing.set_fingerprint(F.col("id")).alias("fingerprint"))


@query(
    """SELECT level, parent, title, count(*) AS n FROM (SELECT DISTINCT 0 AS level, '' AS parent, source AS title FROM documents
      UNION ALL SELECT DISTINCT 1, source, lang FROM documents UNION ALL SELECT DISTINCT 2, source || '/' || lang, CAST(n_chars % 7 AS VARCHAR) FROM documents) GROUP BY ALL"""
)
def export_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that an export of all documents needs, parents before children."""
    paths = table(spark, sf_dir, "documents").select(F.array("source", "lang", (F.col("n_chars") % 7).cast("string")).alias("path"))
    found = trees.path_prefixes(paths.distinct())
    parent = F.coalesce(F.array_join("parent_path", "/"), F.lit(""))
    return found.groupBy("level", parent.alias("parent"), "title").agg(F.count("*").alias("n"))


@query(
    """WITH pages AS (SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 0), x AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0),
    kept AS (SELECT * FROM pages WHERE doc_id NOT IN (SELECT doc_id FROM x)), staged AS (SELECT doc_id FROM labels WHERE quality = 1)
    SELECT source, n_total, n_kept, n_left, first_left, (SELECT count(*) FROM x WHERE doc_id IN (SELECT doc_id FROM pages)) AS n_excluded,
      (SELECT count(*) FROM x WHERE doc_id NOT IN (SELECT doc_id FROM pages)) AS n_stale
    FROM (SELECT source, count(*) AS n_total FROM pages GROUP BY source) LEFT JOIN (SELECT source, count(*) AS n_kept FROM kept GROUP BY source) USING (source)
      LEFT JOIN (SELECT source, count(*) AS n_left, min(doc_id) AS first_left FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM staged) GROUP BY source) USING (source)"""
)
def excluded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, of which a tenth lies in the bin: those that an exclusion list leaves, and of these those not captured yet, by source."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    pages = docs.select(F.col("doc_id").alias("page_id"), "source", (F.col("doc_id") % 10 == 0).alias("in_recycle_bin"))
    kept, counts = scans.without_excluded(pages, labels.where("toxic = 0").select(F.col("doc_id").alias("page_id")).distinct())
    rest = snapshot.not_yet_captured(kept, labels.where("quality = 1").select(F.col("doc_id").alias("page_id")), "page_id")
    total = pages.where("not in_recycle_bin").groupBy("source").agg(F.count("*").alias("n_total"))
    found = total.join(kept.groupBy("source").agg(F.count("*").alias("n_kept")), "source", "left").join(
        rest.groupBy("source").agg(F.count("*").alias("n_left"), F.min("page_id").alias("first_left")), "source", "left"
    )
    told = counts.first()  # one row
    return found.withColumns({"n_excluded": F.lit(told["n_excluded"]), "n_stale": F.lit(told["n_stale"])})


@query(
    """SELECT l_suppkey, rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER
      (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 100"""
)
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best rows of each supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return selection.top_k(rows, ["l_suppkey"], order, 100).select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """WITH s AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY ALL),
    p AS (SELECT l_orderkey, coalesce(a.parts, []) AS pa, coalesce(b.parts, []) AS pb FROM (SELECT * FROM s WHERE l_returnflag = 'A') a
      FULL JOIN (SELECT * FROM s WHERE l_returnflag = 'N') b USING (l_orderkey))
    SELECT l_orderkey, array_to_string(list_filter(pa, lambda x: NOT list_contains(pb, x)), ',') AS missing,
      array_to_string(list_filter(pb, lambda x: NOT list_contains(pa, x)), ',') AS added, len(list_intersect(pa, pb)) AS n_common FROM p"""
)
def resource_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order that only one of two states holds."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))).alias("a"),
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey")))).alias("b"),
    ).where(F.size("a") + F.size("b") > 0)

    def text(c):
        return F.array_join(c.cast("array<string>"), ",")

    missing, added, common = multisets.set_differences(F.col("a"), F.col("b"))
    return sets.select("l_orderkey", text(missing).alias("missing"), text(added).alias("added"), F.size(common).cast("long").alias("n_common"))


@query(
    """WITH refs AS (SELECT DISTINCT page_id AS note_id, unnest([md5(url), md5(html)]) AS ref FROM pages),
    held AS (SELECT page_id AS note_id, md5(url) AS ref FROM pages WHERE page_id % 3 <> 0 UNION SELECT page_id, md5(CAST(page_id AS VARCHAR)) FROM pages)
    SELECT status, referenced, count(*) AS n, min(note_id) AS first_note, max(note_id) AS last_note FROM (
      SELECT coalesce(r.note_id, h.note_id) AS note_id, CASE WHEN h.ref IS NULL THEN 'missing' ELSE 'ok' END AS status, r.ref IS NOT NULL AS referenced
      FROM refs r FULL JOIN held h ON r.note_id = h.note_id AND r.ref = h.ref) GROUP BY status, referenced"""
)
def reference_vs_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources that bodies refer to against those attached: missing, unreferenced, or both."""
    pages = table(spark, sf_dir, "pages")

    def md5(c) -> F.Column:
        return F.md5(c.cast("binary"))

    notes = pages.select(F.col("page_id").alias("note_id"), F.concat(F.lit("![a](:/"), md5(F.col("url")), F.lit(") [b](:/"), F.upper(md5(F.col("html"))), F.lit(")")).alias("body"))
    attached = pages.where("page_id % 3 <> 0").select(F.col("page_id").alias("note_id"), md5(F.col("url")).alias("ref")).unionByName(
        pages.select(F.col("page_id").alias("note_id"), md5(F.col("page_id").cast("string")).alias("ref"))
    )
    found = scans.referenced_resources(notes, attached)
    return found.groupBy("status", "referenced").agg(F.count("*").alias("n"), F.min("note_id").alias("first_note"), F.max("note_id").alias("last_note"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(
    f"""WITH d AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, line FROM ({LINES})),
    c AS (SELECT pair, line, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM d GROUP BY pair, line)
    SELECT pair, sum(greatest(a - b, 0)) AS n_missing, sum(greatest(b - a, 0)) AS n_added, sum(least(a, b)) AS n_kept FROM c GROUP BY pair"""
)
def multiset_block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of neighbouring documents as multisets: missing, added, kept."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select(
        F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), F.explode(F.split("text", "\n")).alias("line")
    )
    found = multisets.multiset_diff(lines.where("side = 0"), lines.where("side = 1"), ["pair"], ["line"])
    return found.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n_missing", "n_added", "n_kept")])


@query(
    """WITH planned AS (SELECT c_custkey AS id, c_name AS title, c_nationkey AS path FROM customer WHERE c_custkey % 11 <> 0),
    found AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_name || '!' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS path FROM customer WHERE c_custkey % 13 <> 0
      UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 13 <> 0),
    g AS (SELECT id, count(*) AS n, min(title) AS title, min(path) AS path FROM found GROUP BY id),
    j AS (SELECT coalesce(p.id, g.id) AS id, p.id IS NULL AS unplanned, g.id IS NULL AS absent, coalesce(g.n, 0) AS n, p.title <> g.title AS bad_title, p.path <> g.path AS bad_path FROM planned p FULL JOIN g ON p.id = g.id)
    SELECT kind, count(*) AS n_issues FROM (
      SELECT 'unexpected-exported-source-id' AS kind FROM j WHERE unplanned UNION ALL SELECT 'exported-note-missing' FROM j WHERE absent
      UNION ALL SELECT 'duplicate-exported-note' FROM j WHERE NOT unplanned AND n > 1 UNION ALL SELECT 'wrong-export-title' FROM j WHERE NOT unplanned AND n = 1 AND bad_title
      UNION ALL SELECT 'wrong-export-path' FROM j WHERE NOT unplanned AND n = 1 AND bad_path) GROUP BY kind"""
)
def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a migrated collection against its plan, counted by kind."""
    from skarn.plans.validate import note_issues

    customer = table(spark, sf_dir, "customer")
    path = F.array(F.col("c_nationkey").cast("string"))
    planned = customer.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), path.alias("path"))
    found = customer.where("c_custkey % 13 <> 0").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("title"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("0"))).otherwise(path).alias("path"),
    )
    twice = customer.where("c_custkey % 17 = 0 and c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), path.alias("path"))
    return note_issues(planned, found.unionByName(twice)).groupBy("kind").agg(F.count("*").alias("n_issues"))


@query(
    """SELECT grouping_id, confidence, kind, n FROM (
      SELECT 1 AS grouping_id, o_orderstatus AS confidence, NULL AS kind, count(*) AS n FROM orders GROUP BY o_orderstatus
      UNION ALL SELECT 2, NULL, o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)"""
)
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent counts by two columns in one pass."""
    from skarn.plans.audit import count_by_each

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("confidence"), F.col("o_orderpriority").alias("kind"))
    return count_by_each(orders, ["confidence", "kind"])


@query(
    """SELECT l_orderkey, sha256('[' || string_agg(j, ',' ORDER BY j) || ']') AS inventory_hash, count(*) AS n FROM (
      SELECT l_orderkey, '{"line":' || l_linenumber || ',"order":' || l_orderkey || ',"part":' || l_partkey || '}' AS j FROM lineitem) GROUP BY l_orderkey"""
)
def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each order's records in the order of their canonical JSON, whatever order they are stored in."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part")
    ).withColumn("j", hashing.canonical_row("order", "part", "line"))
    return rows.groupBy("l_orderkey").agg(hashing.sorted_digest(F.col("j")).alias("inventory_hash"), F.count("*").alias("n"))
