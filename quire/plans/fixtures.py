"""Block and fragment tables derived from `documents` by fixed rules, so that every branch is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.runtime import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents are one; each is a page; each line is a block, decorated by (doc_id * 7 + line) % 17."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    lines = lines.select(
        F.expr("doc_id div 10").alias("doc_id"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("page"),
        F.col("ln").cast("long").alias("ln"),
        "line",
        ((F.col("doc_id") * 7 + F.col("ln")) % 17).alias("m"),
        F.regexp_replace("line", r"\.$", "").alias("np"),
        F.trim(F.translate(F.substring("line", 1, 30), ".!?:;,", "")).alias("hd"),
    )
    text = F.expr("""case m when 0 then concat(cast(ln + 1 as string), ' ', hd) when 1 then concat('2.', cast(ln + 1 as string), ' ', hd)
        when 3 then cast(page as string) when 4 then concat(np, '-') when 5 then np when 6 then np when 7 then concat(cast(ln + 1 as string), '. ', line)
        when 8 then concat('and ', line) when 9 then concat('pre- and ', line) when 10 then hd when 11 then 'Guide header' else line end""")
    blocks = lines.select(
        "doc_id", "page", "ln", text.alias("text"),
        F.expr("case when m in (0, 10) then 14.0D when m = 2 then 8.0D else 10.0D end").alias("font_size"),
        F.expr("m in (1, 12)").alias("bold"),
        F.expr("case when m = 3 then 820.0D else 100.0D + 60 * (ln % 10) end").alias("y0"),
        F.lit(842.0).alias("page_height"),
    ).where("text <> ''")
    return blocks.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ln")).cast("long")).drop("ln")


def words_as_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a page as fragments on a grid in which some rows merge into one line."""
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("pos", "word"))
    return words.selectExpr(
        "doc_id div 10 as doc_id",
        "cast(doc_id % 10 + 1 as int) as page",
        "cast(pos + 1 as bigint) as seq",
        "50.0D + 7 * (pos % 8) as x",
        "60.0D + 14 * (pos div 8) + (case when (pos div 8) % 6 = 5 then 12 else 0 end) + 0.25D * (pos % 3) as y_top",
        "case when (pos div 8) % 9 = 4 then 14.0D else 10.0D end as size",
        "(doc_id + pos) % 5 < 2 as bold",
        "concat(word, ' ') as text",
    ).withColumn("y_r", F.bround("y_top", 1)).withColumn("size_r", F.col("size"))
