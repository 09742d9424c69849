"""Sinks: one JSON file of one document, or tables of many."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import envelopes, preview, records


def write_json(paras: DataFrame, source: str, path: Path, indent: int = 2) -> int:
    """Writes the envelope of one document as UTF-8 JSON with a line feed at the end; indent 0 means one line. Returns the number of paragraphs."""
    found = envelopes(paras).select("extracted_at", "paragraph_count", F.to_json("paragraphs", {"ignoreNullFields": "false"}).alias("p")).first()
    at, n, rows = (found.extracted_at, found.paragraph_count, json.loads(found.p)) if found else (paras.sparkSession.range(1).select(_now()).first()[0], 0, [])
    body = {"source": source, "extracted_at": at, "paragraph_count": n, "paragraphs": rows}
    path.write_text(json.dumps(body, ensure_ascii=False, indent=indent or None) + "\n", encoding="utf-8")
    return n


def _now():
    from quire.functions.text import extracted_at

    return extracted_at()


def write_tables(paras: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Paragraph records of many documents as Parquet or JSON lines; nulls are kept."""
    out = records(paras).write.mode("overwrite")
    out.option("ignoreNullFields", "false").json(path) if fmt == "json" else out.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph records of envelope files."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select("source", F.explode("paragraphs").alias("p")).select("source", "p.*")


def summary(paras: DataFrame, n: int = 3) -> list[str]:
    """Counts, then the first n numbered paragraphs with their headings and page, as lines of text."""
    found = paras.agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("all"), F.count("paragraph_number").alias("numbered")).first()
    lines = [f"{found.docs} documents, {found['all']} paragraphs, {found.numbered} of them numbered"]
    return lines + [f"{r.paragraph_number} | {r.chapter or '-'} | {r.section or '-'} | page {r.page_start} | {r.text}" for r in preview(paras, n).collect()]


def head(paras: DataFrame, n: int = 20):
    """The first n records as a pandas frame."""
    return records(paras).orderBy("doc_id", "id").limit(n).toPandas()
