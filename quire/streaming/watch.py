"""A folder of PDF files as a stream: each new file is a document and goes through the batch plan.

No state spans files, so a micro-batch is a batch; the sink's checkpoint remembers which files were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import layout
from quire.plans import documents as plans
from quire.sources.pdf_source import decode_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def pdf_stream(spark: SparkSession, folder: str, glob: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)


def write_paragraphs(files: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the paragraph records of each micro-batch under batch=<number>, so that a repeated batch overwrites itself. Errors go beside them."""

    def one(batch: DataFrame, number: int) -> None:
        frags = decode_files(batch).persist()
        try:
            paras = plans.records(plans.blocks_to_paragraphs(layout.fragments_to_blocks(frags.where("error is null"))))
            paras.write.mode("overwrite").parquet(f"{out}/paragraphs/batch={number}")
            frags.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        finally:
            frags.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
