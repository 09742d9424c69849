"""Kinds of blocks. Order of precedence: furniture, edge, footnote, heading, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as fn

from .statistics import document_statistics


def at_edge() -> Column:
    """A short unfinished text in the outer 7 % of the page."""
    near = (F.col("y0") < 0.07 * F.col("page_height")) | (F.col("y0") > 0.93 * F.col("page_height"))
    return near & (F.length("text") <= 40) & ~fn.ends_in(F.col("text"), fn.SENTENCE_END)


def is_footnote() -> Column:
    return F.col("font_size") <= F.col("body_size") - 1.5


def is_heading() -> Column:
    text = F.col("text")
    sentence = (F.length(text) > 150) | fn.ends_in(text, ".!?")
    return ~sentence & ((F.col("font_size") >= F.col("body_size") + 1.0) | (F.col("bold") & text.rlike(fn.HEADING_NUMBER)))


def is_section() -> Column:
    return F.col("text").rlike(fn.SECTION_NUMBER)


def with_kinds(blocks: DataFrame) -> DataFrame:
    """Adds body_size and kind. Blocks without text raise nothing and are dropped: no extractor makes any."""
    blocks = blocks.where(F.length(fn.collapse(F.col("text"))) > 0).repartition("doc_id")
    kind = (
        F.when(F.array_contains("furniture", F.col("text")), "furniture")
        .when(at_edge(), "edge")
        .when(is_footnote(), "footnote")
        .when(is_heading(), F.when(is_section(), "section").otherwise("chapter"))
        .otherwise("body")
    )
    return blocks.join(document_statistics(blocks), "doc_id").withColumn("kind", kind).drop("furniture")


def drop_furniture(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    return blocks.join(furniture.select("doc_id", "text"), ["doc_id", "text"], "left_anti")


def keep_furniture(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    return blocks.join(furniture.select("doc_id", "text"), ["doc_id", "text"], "left_semi")
