"""Word arrays and word shingles as column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null for null."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _from(tokens: Column, k: int, width: int) -> Column:
    return F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens) - F.lit(width - 1), F.lit(0)))


def shingle_rows(tokens: Column, width: int) -> Column:
    """Array of structs of `width` neighbouring words; empty for fewer words."""
    return F.arrays_zip(*(_from(tokens, k, width).alias(f"w{k}") for k in range(width)))


def shingle_texts(tokens: Column, width: int) -> Column:
    """Distinct shingles as strings joined by single spaces."""
    return F.array_distinct(F.transform(shingle_rows(tokens, width), lambda s: F.concat_ws(" ", *(s[f"w{k}"] for k in range(width)))))
