"""Per-document statistics over all blocks, before any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BODY = 10.0


def body_font_size(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size: the size with most characters; among equals the one seen first."""
    by_size = blocks.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("chars"), F.min("idx").alias("seen"))
    return by_size.groupBy("doc_id").agg(F.max_by("font_size", F.struct("chars", -F.col("seen"))).alias("body_size"))


def page_counts(blocks: DataFrame) -> DataFrame:
    """doc_id, pages: distinct pages that have blocks."""
    return blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))


def repeated_furniture(blocks: DataFrame) -> DataFrame:
    """doc_id, text, on_pages of texts on at least max(3, a quarter of the pages)."""
    seen = blocks.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("on_pages"))
    enough = F.col("on_pages") >= F.greatest(F.lit(3), F.expr("pages div 4"))
    return seen.join(page_counts(blocks), "doc_id").where(enough).select("doc_id", "text", "on_pages")


def document_statistics(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size and furniture (array of texts), a row a document.

    Everything clusters by doc_id alone, so blocks that are already partitioned by it are not
    shuffled again: pages of a text are counted as a set within its group.
    """
    texts = blocks.groupBy("doc_id", "text").agg(F.collect_set("page").alias("on"))
    furniture = texts.groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("on")))).alias("pages"), F.collect_list(F.when(F.size("on") >= 3, F.struct("text", F.size("on").alias("n")))).alias("often"))
    furniture = furniture.select("doc_id", F.transform(F.filter("often", lambda x: x.n >= F.greatest(F.lit(3), F.expr("pages div 4"))), lambda x: x.text).alias("furniture"))
    return body_font_size(blocks).join(furniture, "doc_id")
