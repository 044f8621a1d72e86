"""Queries over parsed bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.normalize import columns
from skarn.plans.registry import query
from skarn.plans.tables import table
from skarn.sources.reading import spread


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and body: nothing else goes through the parser's workers."""
    return spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body")))


@query()
def html_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, text length and block count of every page's tree."""
    wanted = ["semantic_sha256", "text_sha256", "text", "blocks"]
    pages = columns.with_normalized(read_pages(spark, sf_dir), F.lit("html"), F.col("body"), wanted=wanted)
    return pages.select("page_id", "semantic_sha256", "text_sha256", F.length("text").alias("n_chars"), F.size("blocks").alias("n_blocks"))


@query()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of every page in document order."""
    pages = columns.with_normalized(read_pages(spark, sf_dir), F.lit("html"), F.col("body"), wanted=["links"])
    return pages.select("page_id", F.posexplode("links").alias("place", "href"))


@query()
def rendered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees rendered as HTML and read again: the text stays, and the digest too unless a link was unsafe."""
    digests = ["semantic_sha256", "text_sha256"]
    pages = columns.with_normalized(read_pages(spark, sf_dir), F.lit("html"), F.col("body"), wanted=[*digests, "html"])
    again = pages.select("page_id", F.col("semantic_sha256").alias("first"), F.col("text_sha256").alias("first_text"), F.col("html").alias("body"))
    return columns.with_normalized(again, F.lit("html"), F.col("body"), wanted=digests).select("page_id", "first", F.col("semantic_sha256").alias("second"), (F.col("first") == F.col("semantic_sha256")).alias("same"),
        (F.col("first_text") == F.col("text_sha256")).alias("same_text"),
    )


@query()
def markdown_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents read as Markdown."""
    docs = columns.with_normalized(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("text", "body"), F.lit("markdown"), F.col("body"), wanted=["semantic_sha256", "text_sha256"])
    return docs.select("doc_id", "semantic_sha256", "text_sha256")


@query()
def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of neighbouring pages as multisets, by kind."""
    from skarn.operators.multisets import describe_counts, multiset_diff

    pages = columns.with_normalized(read_pages(spark, sf_dir), F.lit("html"), F.col("body"), wanted=["blocks"])
    blocks = pages.select(F.floor(F.col("page_id") / 2).alias("pair"), (F.col("page_id") % 2).alias("side"), F.explode("blocks").alias("b")).select("pair", "side", "b.kind", "b.sha256")
    found = multiset_diff(blocks.where("side = 0"), blocks.where("side = 1"), ["pair"], ["kind", "sha256"])
    return describe_counts(found, ["pair"], "kind", "n_missing", "missing")
