"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of distinct shingles, in powers of two). Rows that
repeat an item_id are items of their own here. The MinHash sketch of an item holds the least hash values of its
shingles, as many as its partition's largest size u needs: floor((1 - t) u) + 1.
A document that holds at least the share t of an item's shingles lacks fewer than that, so it holds
one of the sketch: no document is missed. The search joins document shingles with the sketches by hash value;
each candidate is verified by the exact share of the item's shingles that the document holds.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import unused, written
from .words import shingle_rows, shingle_texts, words

WIDTH, CONTAINMENT = 5, 0.8
#: Sketch rows that are broadcast at once (16 bytes each); more items are searched for in blocks.
BLOCK = 200_000


def _hash(row: str, width: int):
    return F.xxhash64(*(F.col(f"{row}.w{k}") for k in range(width)))


def sketches(items: DataFrame, width: int, containment: float) -> DataFrame:
    """item_id, h, the least hash values of every different row of items; smaller rows have fewer."""
    rows = items.select("item_id", F.xxhash64("text").alias("row"), F.explode(shingle_rows(words(F.col("text")), width)).alias("s"))
    hashed = rows.select("item_id", "row", _hash("s", width).alias("h")).distinct()
    by_item = Window.partitionBy("item_id", "row")
    ranked = hashed.withColumns({"n": F.count(F.lit(1)).over(by_item), "rank": F.row_number().over(by_item.orderBy("h"))})
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1  # of the size partition
    return ranked.where(F.col("rank") <= F.floor(largest * (1 - containment) + 1e-9) + 1).select("item_id", "h").distinct()


def candidates(docs: DataFrame, items: DataFrame, width: int, containment: float) -> DataFrame:
    """doc_id, item_id of pairs that share a sketch value."""
    sketch = written(sketches(items, width, containment).withColumn("part", F.pmod(F.xxhash64("item_id", "h"), F.lit(1 << 20))), "leak-sketches")
    blocks = max(1, -(-2 * sketch.count() // BLOCK))
    shingles = docs.select("doc_id", F.explode(shingle_rows(words(F.col("text")), width)).alias("s")).select("doc_id", _hash("s", width).alias("h"))
    found = None
    for k in range(blocks):
        block = sketch.where(F.col("part") % blocks == k).select("item_id", "h")
        block = F.broadcast(block) if blocks == 1 or block.count() <= BLOCK else block
        here = shingles.join(block, "h").select("doc_id", "item_id")
        found = here if found is None else found.union(here)
    return written(found.distinct(), "leak-candidates")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment of every pair that reaches the containment.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Items and
    documents with fewer words than a shingle match nothing, as do null texts. Rows that repeat an id
    count with the best row of that id; null ids match as one id. Empty tables give no rows.
    """
    docs, items = docs.select("doc_id", F.col("text").cast("string").alias("text")), items.select("item_id", F.col("text").cast("string").alias("text"))
    pairs = candidates(docs, items, width, containment)
    wanted = items.select("item_id", shingle_texts(words(F.col("text")), width).alias("item"))
    by_doc = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    held = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "i", shingle_texts(words(F.col("text")), width).alias("doc"))
    both = held.join(wanted, F.col("i").eqNullSafe(F.col("item_id")))
    shared = F.size(F.array_intersect("item", "doc")).cast("long")
    scored = both.select("doc_id", "item_id", shared.alias("shared"), F.size("item").cast("long").alias("n_shingles")).withColumn("containment", F.col("shared") / F.col("n_shingles"))
    best = scored.where(F.col("containment") >= containment).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.n_shingles", "b.containment")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose id holds no item.

    Rows that repeat an id go together if one of them holds an item; rows with a null id count as one id. Null and empty texts
    hold none; columns of any other name stay as they are; an empty table gives an empty one.
    """
    doc = unused("doc", docs)
    found = written(leaks(docs, items).select(F.col("doc_id").alias(doc)).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")


def oracle(width: int = WIDTH, containment: float = CONTAINMENT) -> str:
    def shingles(table: str, key: str) -> str:
        join = " || ' ' || ".join(f"ws[k + {j}]" for j in range(width))
        return f"""SELECT DISTINCT {key}, {join} AS s FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {width - 2})) AS k
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {table}))"""

    return f"""WITH d AS ({shingles("documents", "doc_id")}), i AS ({shingles("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / any_value(n_shingles) >= {containment}::double"""
