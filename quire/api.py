"""The library's names for use from plain Python: lists in, lists out, DataFrame plans between.

For tables of many documents use quire.plans and quire.operators directly.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import layout, statistics
from quire.plans import documents as plans
from quire.schema import PARAGRAPH_FIELDS
from quire.sources.pdf.content import Fragment
from quire.sources.pdf.filters import apply_predictor
from quire.sources.pdf.fonts import Font, parse_tounicode

DEFAULT_BODY = statistics.DEFAULT_BODY
_DOTTED = re.compile(r"\d+(\.\d+)+\s+\S")
_BLOCK = "doc_id string, idx long, text string, page int, font_size double, bold boolean, y0 double, page_height double"


@dataclass
class Block:
    text: str
    page: int
    font_size: float
    bold: bool = False
    y0: float = 0.0
    page_height: float = 842.0


@dataclass
class Paragraph:
    text: str
    page_start: int
    page_end: int
    chapter: str | None = None
    section: str | None = None
    paragraph_number: str | None = None

    def to_json(self, idx: int) -> dict:
        return {"id": idx, **{k: getattr(self, k) for k in PARAGRAPH_FIELDS[1:]}}


class HeadingState:
    """Chapter and section in force after the headings seen so far; tables of blocks use paragraphs.heading_context."""

    def __init__(self, chapter: str | None = None, section: str | None = None):
        self.chapter, self.section = chapter, section

    def update(self, heading_text: str) -> None:
        if _DOTTED.match(heading_text):
            self.section = heading_text
        else:
            self.chapter, self.section = heading_text, None


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("quire").getOrCreate()


def block_table(blocks: list[Block], spark: SparkSession | None = None) -> DataFrame:
    rows = [("", k, b.text, b.page, float(b.font_size), b.bold, float(b.y0), float(b.page_height)) for k, b in enumerate(blocks)]
    return session(spark).createDataFrame(rows, _BLOCK)


def join_lines(lines: list[str], spark: SparkSession | None = None) -> str:
    df = session(spark).createDataFrame([(lines,)], "lines array<string>")
    return df.select(fn.join_lines(F.col("lines")).alias("joined")).first().joined


def body_font_size(blocks: list[Block], spark: SparkSession | None = None) -> float:
    found = statistics.body_font_size(block_table(blocks, spark)).first()
    return found.body_size if found else DEFAULT_BODY


def segment_paragraphs(blocks: list[Block], spark: SparkSession | None = None) -> list[Paragraph]:
    rows = plans.blocks_to_paragraphs(block_table(blocks, spark)).orderBy("id").collect()
    return [Paragraph(r.text, r.page_start, r.page_end, r.chapter, r.section, r.paragraph_number) for r in rows]


def build_output(paras: list[Paragraph], source: str, spark: SparkSession | None = None) -> dict:
    at = session(spark).range(1).select(fn.extracted_at().alias("at")).first()["at"]
    return {"source": source, "extracted_at": at, "paragraph_count": len(paras), "paragraphs": [p.to_json(k) for k, p in enumerate(paras, 1)]}


def group_lines(frags: list[Fragment], y_tol: float = layout.LINE_TOLERANCE, spark: SparkSession | None = None) -> list[dict]:
    rows = [("", k, f.page, float(f.x), float(f.y_top), float(f.size), f.bold, f.text) for k, f in enumerate(frags)]
    df = session(spark).createDataFrame(rows, "doc_id string, seq long, page int, x double, y_top double, size double, bold boolean, text string")
    lines = layout.finish_lines(layout.with_lines(df, y_tol)).orderBy("page", "line_no").collect()
    return [{k: r[k] for k in ("text", "x", "y_top", "size", "bold", "page")} for r in lines]


__all__ = ["Block", "Font", "Fragment", "HeadingState", "Paragraph", "apply_predictor", "asdict", "body_font_size", "build_output", "group_lines", "join_lines", "parse_tounicode", "segment_paragraphs"]
