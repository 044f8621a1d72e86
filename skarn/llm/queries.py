"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm.common import table
from skarn.sources.reading import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.token_counts import section_token_counts

    return section_token_counts(documents(spark, sf_dir))


def op2_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.embedding_dups import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.substring import remove_repeated

    return remove_repeated(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.bpe import encode_and_decode

    return encode_and_decode(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.packing import pack

    return pack(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.toxicity import classify

    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.nearest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.quality import classify

    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.token_files import round_trip

    return round_trip(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_embedding_dups, op3_substring, op4_simhash, op5_bpe, op6_packing,
        op7_toxicity, op8_nearest, op9_quality, op10_token_files,
    )
    return {f.__name__: f for f in found}


#: Vectors that can link, all pairs within a label, and what each reaches.
EMBEDDING_DUPS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""

#: All windows of 35 words as texts, and the words that no repeated one covers.
SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win JOIN again USING (k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t
  FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, XXH64 with a seed, trained models and packing are beyond SQL, and a distance in double
    precision depends on the order of its sum: those queries are tested against brute force."""
    return {"op2_embedding_dups": EMBEDDING_DUPS, "op3_substring": SUBSTRING}
