"""Queries over texts, markup and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import hashing, markup, text, times
from skarn.operators import joins, selection
from skarn.operators.components import checkpointed
from skarn.plans.registry import query
from skarn.plans.tables import table
from skarn.sources.reading import spread

#: Normalized text in DuckDB, for inputs without exotic white space at line edges.
NORMAL = r"""
array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g'), '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'),
  '[\x{00A0}\x{202F}\x{2007}]', ' ', 'g'), '[ \t\f\v]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))
"""
DIGESTS = f"digests AS (SELECT doc_id, lang, source, norm, sha256(norm) AS digest FROM (SELECT doc_id, lang, source, {NORMAL} AS norm FROM documents))"


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", text.normalize_text(F.col("text")).alias("norm"))
    return docs.withColumn("digest", hashing.digest(F.col("norm")))


@query(f"WITH {DIGESTS} SELECT doc_id, digest, length(norm) AS norm_chars FROM digests")
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the normalized text of every document."""
    return digests(spark, sf_dir).select("doc_id", "digest", F.length("norm").cast("long").alias("norm_chars"))


@query(
    f"""WITH {DIGESTS},
    l AS (SELECT digest, min(doc_id) AS left_id FROM digests WHERE doc_id % 2 = 0 GROUP BY digest HAVING count(*) = 1),
    r AS (SELECT digest, min(doc_id) AS right_id FROM digests WHERE doc_id % 2 = 1 GROUP BY digest HAVING count(*) = 1)
    SELECT digest, left_id, right_id FROM l JOIN r USING (digest)"""
)
def unique_digest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the corpus, linked by digests that either half holds once."""
    both = digests(spark, sf_dir).select("doc_id", "digest")
    left = both.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id")
    right = both.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return joins.unique_key_join(left, right, "digest")


@query(
    f"""WITH {DIGESTS} SELECT digest, doc_id, n, first_id, first_source FROM (SELECT digest, doc_id, count(*) OVER w AS n, min(doc_id) OVER w AS first_id,
      arg_min(source, doc_id) OVER w AS first_source FROM digests WINDOW w AS (PARTITION BY digest)) WHERE n > 1"""
)
def duplicate_digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups with one digest, with the group's size and first row. A group is never one row."""
    every = checkpointed(digests(spark, sf_dir).select("doc_id", "digest", "source"))  # texts are normalized once
    found = selection.members_of_groups(every, "digest", F.struct("doc_id", "source"), F.col("doc_id"))
    return found.select("doc_id", "digest", "n", F.col("first.doc_id").alias("first_id"), F.col("first.source").alias("first_source"))


@query(
    f"""WITH {DIGESTS}, longer AS (SELECT * FROM digests WHERE length(norm) >= 20),
    l AS (SELECT source, lang, digest, min(doc_id) AS left_id FROM longer WHERE doc_id % 2 = 0 GROUP BY ALL HAVING count(*) = 1),
    r AS (SELECT source, lang, digest, min(doc_id) AS right_id FROM longer WHERE doc_id % 2 = 1 GROUP BY ALL HAVING count(*) = 1)
    SELECT source, lang, digest, left_id, right_id FROM l JOIN r USING (source, lang, digest)""".replace("GROUP BY ALL", "GROUP BY source, lang, digest")
)
def same_section_digest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``unique_digest_link``, within a section, for texts of some length."""
    some = digests(spark, sf_dir).where(F.length("norm") >= text.MIN_TEXT_HASH).select("doc_id", "source", "lang", "digest")
    left = some.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id")
    right = some.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return joins.unique_key_join(left, right, "source", "lang", "digest")


@query(
    r"""SELECT event_id, epoch_us(ts) // 1000 AS at_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
    epoch_us(ts) // 1000000 AS at_s, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""
)
def epoch_iso_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps to numbers, to ISO text and back."""
    at = table(spark, sf_dir, "events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.get_json_object("props", "$.k").cast("long").alias("k")
    ).withColumn("iso", times.iso_from_epoch_ms(F.col("at_ms")))
    return at.withColumn("at_s", times.epoch_seconds(F.col("iso")))


BODY = "html || ' ![a](:/' || md5(url) || ') [b](:/' || upper(md5(url)) || ') [c](:/' || md5(html) || ')'"


@query(
    f"""SELECT page_id, array_to_string(list_distinct_ordered, ',') AS refs, len(list_distinct_ordered) AS n_refs, embedded FROM (
    SELECT page_id, list_filter(all_refs, lambda x, i: list_position(all_refs, x) = i) AS list_distinct_ordered,
      CASE WHEN page_id % 2 = 0 THEN url_decode(url_encode(url)) END AS embedded
    FROM (SELECT page_id, url, list_transform(regexp_extract_all({BODY}, ':/([0-9a-fA-F]{{32}})', 1), lambda x: lower(x)) AS all_refs FROM pages))"""
)
def resource_ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource ids that bodies refer to, and page ids embedded in source URLs."""
    pages = table(spark, sf_dir, "pages").withColumn("body", F.expr(BODY))
    source_url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("onenote://page/"), markup.quote_url(F.col("url"))))
    refs = markup.resource_refs(F.col("body"))
    return pages.select(
        "page_id", F.array_join(refs, ",").alias("refs"), F.size(refs).cast("long").alias("n_refs"),
        markup.embedded_id(source_url, F.lit("")).alias("embedded"),
    )


@query(
    r"""WITH bodies AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
    told AS (SELECT kind, id, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS lang, body FROM bodies)
    SELECT kind, id, CASE WHEN lang = 2 THEN 'html' WHEN lang = 1 AND regexp_matches(body, '<[a-zA-Z][^>]*>') THEN 'mixed'
      WHEN lang = 1 THEN 'markdown' ELSE 'unknown' END AS format FROM told"""
)
def content_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored format of pages and documents."""
    bodies = (
        table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
        .unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    )
    language = F.when(F.col("id") % 4 == 0, 2).when((F.col("id") % 4).isin(1, 2), 1)
    return bodies.select("kind", "id", markup.content_format(language, F.col("body")).alias("format"))


@query(
    r"""SELECT page_id, url_encode(url) AS quoted, (starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, 'onenote:')
      OR starts_with(u, ':/') OR starts_with(u, 'app://')) AS safe,
    replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
    replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS attribute
    FROM (SELECT page_id, url, lower(trim(url)) AS u FROM pages)"""
)
def url_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL quoting, the list of safe URLs, and HTML escapes."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", markup.quote_url(url).alias("quoted"), markup.is_safe_url(url, more=("app://",)).alias("safe"),
        markup.escape_html(url).alias("escaped"), markup.escape_html(url, attribute=True).alias("attribute"),
    )


@query(
    r"""SELECT page_id, regexp_replace(stem, '\s*\([^()]*(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})[^()]*\)\s*$', '') AS logical, ext FROM (
      SELECT page_id, 'Notes (' || page_id || ') (On 2024-01-' || (page_id % 28 + 1) || ')' AS stem,
        CASE page_id % 3 WHEN 0 THEN '.one' WHEN 1 THEN '.png' ELSE '' END AS ext FROM pages)"""
)
def logical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without their dated suffix, and safe extensions."""
    pages = table(spark, sf_dir, "pages")
    stem = F.concat(F.lit("Notes ("), F.col("page_id"), F.lit(") (On 2024-01-"), F.col("page_id") % 28 + 1, F.lit(")"))
    name = F.when(F.col("page_id") % 3 == 0, "a\\b/c.One").when(F.col("page_id") % 3 == 1, "x.y.PNG").otherwise("none.toolongextension")
    return pages.select("page_id", markup.logical_title(stem).alias("logical"), markup.safe_extension(name).alias("ext"))


@query(
    """SELECT conv_id, role, run, count(*) AS n_turns, min(turn) AS first_turn, sum(length(text)) AS n_chars FROM (
      SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
        SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS b
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY conv_id, role, run"""
)
def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role."""
    found = selection.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return found.groupBy("conv_id", "role", "run").agg(
        F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    """SELECT event_type, n, n_inside, CASE WHEN n_inside / n >= 0.5 THEN a END AS window_start, CASE WHEN n_inside / n >= 0.5 THEN b END AS window_end FROM (
      SELECT event_type, count(*) AS n, count(*) FILTER (abs(t - m) <= 604800) AS n_inside, min(t) FILTER (abs(t - m) <= 604800) AS a,
        max(t) FILTER (abs(t - m) <= 604800) AS b FROM (
          SELECT event_type, epoch_us(ts) // 1000000 AS t, median(epoch_us(ts) // 1000000) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type)"""
)
def import_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window in which most events of a type lie, around their exact median."""
    at = table(spark, sf_dir, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return selection.import_window(at, ["event_type"], "at")


@query(
    """SELECT user_id, event_id, round(CASE WHEN d IS NULL THEN NULL WHEN d <= 120 THEN 1.0 ELSE pow(2.0, -d / 604800.0) END, 6) AS similarity FROM (
      SELECT user_id, event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM events))"""
)
def time_decay_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near in time an event is to the user's last one."""
    from skarn.operators.features import time_similarity

    at = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return at.withColumn("b", before).select("user_id", "event_id", F.round(time_similarity(F.col("at"), F.col("b")), 6).alias("similarity"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS at FROM events),
    p AS (SELECT l.event_id AS left_id, r.event_id AS right_id, l.at - r.at AS delta FROM e l JOIN e r
      ON l.user_id = r.user_id AND l.event_type = r.event_type AND abs(l.at - r.at) <= 3600 WHERE l.event_id % 2 = 0 AND r.event_id % 2 = 1)
    SELECT left_id, right_id, delta FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS a, count(*) OVER (PARTITION BY right_id) AS b FROM p) WHERE a = 1 AND b = 1"""
)
def band_join_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and type within an hour of each other, where neither has another partner."""
    at = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    left = at.where("event_id % 2 = 0").select("user_id", "event_type", F.col("event_id").alias("left_id"), F.col("at").alias("left_at"))
    right = at.where("event_id % 2 = 1").select("user_id", "event_type", F.col("event_id").alias("right_id"), F.col("at").alias("right_at"))
    pairs = joins.band_join(left, right, ["user_id", "event_type"], "left_at", "right_at", 3600)
    return joins.mutual_only(pairs, "left_id", "right_id").select("left_id", "right_id", (F.col("left_at") - F.col("right_at")).alias("delta"))


@query()
def greedy_time_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``band_join_unique``, but in order, each link using up its target."""
    at = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
        hashing.record_order(F.col("event_id").cast("string")).alias("ord"),
    )
    return joins.greedy_band_link(at.where("id % 2 = 0"), at.where("id % 2 = 1"), ["user_id", "event_type"], "at", "ord", 3600)
