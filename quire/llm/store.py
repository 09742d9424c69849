"""Places that the driver and every executor can reach, and tables written there.

Intermediate results that are read more than once are written as Parquet below the folder named by
``spark.checkpoint.dir``: a lost executor then costs a re-read, never a wrong or partial result.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quire.runtime import ship

_DIR = "spark.checkpoint.dir"
#: Bytes of a batch that goes to a Python worker. By rows alone, ten thousand long texts would go at once.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: Whether shuffle files go as soon as their query ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bits that mark a set of keys (4 MB, however many keys; more keys set more bits), and bits to a row of them.
BITS, _SLICE = 1 << 25, 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; in local mode, where it may be unset, a temporary one is made and recorded."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {_DIR} to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
    spark.conf.set(_DIR, made)
    return made


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quire/{tag}-{uuid.uuid4().hex}"


def bounded(spark: SparkSession) -> None:
    """Bounds the batches of this session, where it has no bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once, as a table in the shared folder; the shuffle files of its query are removed, as the table takes their place."""
    spark = df.sparkSession
    bounded(spark)
    path = new_dir(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker process, which is kept for other tasks, gives what it has freed back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not in every C library
            ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Asks every executor's JVM to collect its garbage, so that heap and direct buffers that earlier work has left go back to the system. By itself
    a JVM keeps all heap that it ever took, up to its limit, and the Python workers come on top. One task for each executor: an idle cluster gives
    each of them one; where it does not, more memory is kept, and no result changes."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is one of them
    n = max(1, executors)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def unused(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores after it: a column that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_bits(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for the remainder by BITS of every key: a key without its bit is surely not among them."""
    at = F.pmod(F.col(column), F.lit(BITS))
    found = keys.groupBy(F.floor(at / _SLICE).alias("slice")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_SLICE))).alias("bits")).collect()  # BITS / _SLICE rows at most
    out = np.zeros(BITS // 8, np.uint8)
    for r in found:
        out[r.slice * _SLICE // 8 :][: _SLICE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def may_be_in(keys: DataFrame, column: str, value: Column) -> Column:
    """Whether value, a long without nulls, may be one of the keys. Rows that are not need not be shuffled to be joined with them."""
    bits = keys.sparkSession.sparkContext.broadcast(key_bits(keys, column))

    @F.arrow_udf(BooleanType())
    def known(x: pa.Array) -> pa.Array:
        at = np.mod(x.to_numpy(zero_copy_only=False), BITS)
        return pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return known(value)
