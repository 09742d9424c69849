"""Minimax contiguous sharding of documents whose equal texts stay together.

Documents are ordered by (digest of the text, doc_id); equal texts are neighbours and form one atomic
group. The smallest capacity that lets K contiguous shards hold all groups is found by binary search;
each trial cuts greedily. The trials run on the driver against a *coarse index* of the possible cut
positions (bounded: smallest and largest cut position per cell of the size axis). A lookup that the index cannot answer
exactly names the cell to refine; one aggregation refines all such cells, and the search is repeated
until every lookup on its path was exact. Rows never leave the executors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts, written

ROOT_CELLS, SUB_CELLS = 1 << 15, 1 << 8


class CutIndex:
    """Cut positions (running sizes at group starts), known as a tree of cells with their least and greatest cut."""

    def __init__(self, total: int):
        self.total = total
        self.cells: list[tuple[int, int]] = []  # least and greatest cut, in order
        self.open: set[tuple[int, int]] = set()

    def load(self, cells: list[tuple[int, int]], replaced: set[tuple[int, int]]) -> None:
        kept = [c for c in self.cells if c not in replaced]
        self.cells = sorted(kept + cells)
        self.least = [c[0] for c in self.cells]
        self.open = set()

    def at_most(self, x: int) -> int:
        """The greatest cut <= x; a lower bound of it, with the cell noted, if the index is too coarse."""
        if x >= self.total:
            return self.total
        k = bisect_right(self.least, x) - 1
        if k < 0:
            return 0
        least, greatest = self.cells[k]
        if greatest <= x:
            return greatest
        self.open.add((least, greatest))
        return least

    def above(self, x: int) -> int:
        """The least cut > x, or an upper bound of it with the cell noted."""
        k = bisect_right(self.least, x) - 1
        after = self.cells[k + 1][0] if k + 1 < len(self.cells) else self.total
        if k < 0 or self.cells[k][1] <= x:
            return after
        self.open.add(self.cells[k])
        return self.cells[k][1]

    def fits(self, start: int, shards: int, capacity: int) -> bool:
        for _ in range(shards):
            if start >= self.total:
                return True
            end = self.at_most(start + capacity)
            if end <= start:
                return False
            start = end
        return start >= self.total

    def capacity(self, shards: int) -> int:
        """The least capacity with which a greedy pass needs no more than `shards` shards."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fits(0, shards, mid):
                high = mid
            else:
                low = mid + 1
        return low

    def cuts(self, shards: int) -> list[int]:
        """Starts of the shards after the first. Within the least capacity, each shard aims at an equal part of what is left."""
        most, start, found = self.capacity(shards), 0, []
        for left in range(shards, 1, -1):
            if start >= self.total:
                break
            end = self.at_most(start + -(-(self.total - start) // left))
            if end <= start:
                end = self.above(start)  # one group is larger than the even part
            if not self.fits(end, left - 1, most):
                end = max(self.at_most(start + most), end if end - start <= most else 0)
            start = end
            if start < self.total:
                found.append(start)
        return found


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a sorted partition: its number, the row's place, bytes before the row, and whether a group starts (None: first row)."""
    import numpy as np
    from pyspark import TaskContext

    part, place, size, last = TaskContext.get().partitionId(), 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("gkey").to_pylist()
        sizes = b.column("size").to_numpy()
        before = size + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("int64")
        starts = [None if last is None else key[0] != last, *(x != y for x, y in zip(key[1:], key, strict=False))]
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([part] * n, pa.int64()), pa.array(np.arange(place, place + n)), pa.array(before), pa.array(starts, pa.bool_())],
            names=[*b.schema.names, "part", "place", "before", "starts"],
        )
        place, size, last = place + n, int(before[-1] + sizes[-1]), key[-1]


def _cells(cuts: DataFrame, total: int, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Least and greatest cut in each sub-cell of the windows; without windows, in each root cell.

    A window never leaves its root cell, so the windows meet the cuts by an equi-join on that cell.
    """
    root = F.floor(F.col("cut") / F.lit(max(1, -(-(total + 1) // ROOT_CELLS))))
    got = cuts.select("cut", root.alias("root"), F.lit(0).cast("long").alias("cell"))
    if windows:
        width = max(1, -(-(total + 1) // ROOT_CELLS))
        at = [(lo // width, lo, hi, max(1, -(-(hi - lo + 1) // SUB_CELLS))) for lo, hi in windows]
        w = cuts.sparkSession.createDataFrame(at, "root long, lo long, hi long, width long")
        got = got.drop("cell").join(F.broadcast(w), "root").where(F.col("cut").between(F.col("lo"), F.col("hi")))
        got = got.select("cut", F.col("lo").alias("root"), F.floor((F.col("cut") - F.col("lo")) / F.col("width")).alias("cell"))
    return [(r.a, r.b) for r in got.groupBy("root", "cell").agg(F.min("cut").alias("a"), F.max("cut").alias("b")).select("a", "b").collect()]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard number and slot of every row; law `bytes`.

    Size of a row: UTF-8 bytes of its text plus 8. Returns id, size, text_crc32, law, shard, slot,
    grown_shard (null). The largest shard is as small as contiguous shards of whole groups allow.
    Null and empty texts are equal (size 8) and form one group; null ids sort first; repeated rows are
    kept; a table with fewer groups than shards leaves the last shards empty; an empty table gives no
    rows. Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("gkey")),
        "shard-rows",
    )
    schema = "doc_id long, size long, text_crc32 long, gkey string, part long, place long, before long, starts boolean"
    rows = written(slim.repartitionByRange(parts(spark), "gkey", "doc_id").sortWithinPartitions("gkey", "doc_id").mapInArrow(_number, schema), "shard-order")
    # One line per partition: a number that the session fixes, not the data.
    lines = rows.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("gkey").alias("first"), F.max("gkey").alias("last")).orderBy("part").collect()
    total, n, last, base = 0, 0, None, []
    for r in lines:
        base.append((r.part, total, n, r["first"] != last))
        total, n, last = total + r["size"], n + r.n, r["last"]
    if not base:
        base = [(0, 0, 0, True)]
    offsets = F.broadcast(spark.createDataFrame(base, "part long, base long, n_base long, opens boolean"))
    placed = written(
        rows.join(offsets, "part").select("doc_id", "size", "text_crc32", (F.col("base") + F.col("before")).alias("cut"), (F.col("n_base") + F.col("place")).alias("row"), F.coalesce("starts", "opens").alias("starts")),
        "shard-places",
    )
    positions = placed.where("starts").select("cut")
    index = CutIndex(total)
    index.load(_cells(positions, total, []), set())
    while True:
        cuts = index.cuts(shards)
        if not index.open:
            break
        index.load(_cells(positions, total, sorted(index.open)), set(index.open))
    first = {r.cut: r.row for r in placed.where(F.col("starts") & F.col("cut").isin(cuts)).select("cut", "row").collect()} if cuts else {}
    number, start = F.lit(0), F.lit(0).cast("long")
    for k, cut in enumerate(cuts, 1):
        number = F.when(F.col("cut") >= cut, F.lit(k)).otherwise(number)
        start = F.when(F.col("cut") >= cut, F.lit(first[cut]).cast("long")).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.cast("int").alias("shard"), (F.col("row") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
