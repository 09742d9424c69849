"""Blocks as the PyMuPDF library finds them; used only where it is installed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fn

RAW = "doc_id string, page int, block_no int, lines array<string>, font_size double, bold boolean, y0 double, page_height double"


def available() -> bool:
    from importlib.util import find_spec

    return find_spec("fitz") is not None


def page_blocks(name: str, number: int, page: Any) -> list[tuple]:
    """Rows of the text blocks of one page, as the library gives it: images and blocks without visible text are left out."""
    rows = []
    for k, block in enumerate(page.get_text("dict")["blocks"]):
        lines = [[s for s in line["spans"] if s["text"].strip()] for line in block["lines"]] if block["type"] == 0 else []
        spans = [s for line in lines for s in line]
        if spans:
            size = Counter(round(s["size"], 1) for s in spans).most_common(1)[0][0]
            bold = 2 * sum(bool(s["flags"] & 16) for s in spans) > len(spans)
            rows.append((name, number, k, ["".join(s["text"] for s in line) for line in lines if line], size, bold, block["bbox"][1], page.rect.height))
    return rows


def decode_blocks(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = [r for number, page in enumerate(fitz.open(stream=bytes(content), filetype="pdf"), 1) for r in page_blocks(name, number, page)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    return blocks_of(files.select("path", "content").mapInPandas(run, RAW))


def blocks_of(raw: DataFrame) -> DataFrame:
    blocks = raw.withColumn("text", fn.join_lines(F.col("lines"))).where("text <> ''").drop("lines")
    return blocks.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_no")).cast("long")).drop("block_no")
