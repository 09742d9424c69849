"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most two bits share at least
six of the eight bytes in place. Single-byte posting lists hold a 256th of all fingerprints each, so the pairs on them
grow with the square of the corpus. The index therefore has one list for each choice of six positions (28 in
all), keyed by those bytes: a pair is on a common list if and only if it shares as many positional bytes as is
guaranteed, and a list cannot grow without bound: its members
differ in two bytes only, so it has 65,536 members at most, however many documents there are. For the pairs of a list
the shared positional bytes are tallied; pairs that reach the minimum are verified by the bits in which they
differ. Links within a list are given as a spanning forest, so
no group is ever expanded into all its pairs, and components are found over these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import may_be_in, parts, unused, written

SEED, BITS, BYTES = 42, 64, 8
#: Values of a list up to which its forest is one of least bits; beyond, one by breadth.
LEAST_BITS = 4096


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 values of all shingles of `width` words, in order; of the whole text if it has fewer; none without words."""
    words = text.lower().split()  # bytes: A-Z only, and the white space of ASCII
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    h, seed = xxhash.xxh64_intdigest, SEED
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 values of all shingles of `width` words; 0 without words."""
    hashes = shingle_hashes(text, width)
    return majority(np.array(hashes, "<u8")) if hashes else 0


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, one at least: a bit is 1 if set in over half of them."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    flat = hashes.view(np.uint8).reshape(-1, BYTES)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(flat[k : k + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and text_key (a hash of the text). Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x or b"", width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], names=["doc_id", "fp", "text_key"])

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, "doc_id long, fp long, text_key long")


def _lists(kept: int) -> list[tuple[int, np.uint64]]:
    """Number of each choice of `kept` byte positions, and the mask of those bytes."""
    out = []
    for k, chosen in enumerate(combinations(range(BYTES), kept)):
        out.append((k, np.uint64(sum(0xFF << (8 * p) for p in chosen))))
    return out


def tally(differ: np.ndarray) -> np.ndarray:
    """How many positional bytes the two fingerprints of each difference (exclusive or) share."""
    return (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def _close(differ: np.ndarray, most: int) -> np.ndarray:
    """Places of the differences whose tally reaches the guaranteed minimum and that have at most `most` bits."""
    counted = np.flatnonzero(tally(differ) >= BYTES - most)
    return counted[np.bitwise_count(differ[counted]) <= most]


def _near(values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph that links values with at most `most` differing bits; pairs of places in `values`.

    In short lists every pair is tallied. In a long one with most = 2, every value is filed under itself
    and its one-bit changes: all that differ in two bits at most meet under one key, and neighbours there are tallied.
    """
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(values) <= 256 or most != 2:
        found: Iterator[tuple[int, int]] = ((a, a + 1 + b) for a in range(len(values) - 1) for b in _close(values[a + 1 :] ^ values[a], most).tolist())
    else:
        differ = int(np.bitwise_or.reduce(values ^ values[0]))
        flips = np.array([0, *(1 << k for k in range(BITS) if differ >> k & 1)], np.uint64)
        keys, who = (values[:, None] ^ flips).ravel(), np.repeat(np.arange(len(values)), len(flips))
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        one, two = who[order[same]], who[order[same + 1]]
        kept = _close(values[one] ^ values[two], most)
        found = zip(one[kept].tolist(), two[kept].tolist(), strict=True)
    for a, b in found:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def _forest(values: np.ndarray, most: int, shared: int) -> Iterator[tuple[int, int]]:
    """A spanning forest, as _near gives it, of the graph that links values which share `shared` positional bytes and differ in at most
    `most` bits. Up to LEAST_BITS values its links are those of the fewest bits. In a dense group the first values reach all others, so
    a long list takes few rounds."""
    left = np.arange(1, len(values))
    bits, source, queue = np.full(len(left), BITS + 1), np.zeros(len(left), np.int64), []
    at = 0
    while len(left):
        differ = values[left] ^ values[at]
        now = np.where(tally(differ) >= shared, np.bitwise_count(differ), BITS + 1)
        if len(values) <= LEAST_BITS:
            nearer = now < bits
            bits[nearer], source[nearer] = now[nearer], at
            k = int(np.argmin(bits))
            at, linked = int(left[k]), bits[k] <= most
            if linked:
                yield int(source[k]), at
            keep = np.arange(len(left)) != k
            left, bits, source = left[keep], bits[keep], source[keep]
            continue
        reached = now <= most
        for b in left[reached].tolist():
            yield at, b
            queue.append(b)
        left = left[~reached]
        if queue:
            at = queue.pop()
        elif len(left):
            at, left = int(left[0]), left[1:]


def _link(most: int, shared: int):
    forest = _near if shared == BYTES - most else lambda values, most: _forest(values, most, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the lists of a partition sorted by (list, key)."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(which: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
            a_, b_ = [], []
            for k in np.flatnonzero(ends - starts > 1).tolist():
                values = fp[starts[k] : ends[k]]
                for a, b in forest(values.view(np.uint64), most):
                    a_.append(values[a])
                    b_.append(values[b])
            return pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], schema=schema) if a_ else None

        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("which", "key", "fp")]
            if not len(cols[0]):
                continue
            held.append(cols)
            which, key, _ = cols
            change = np.flatnonzero((which != which[-1]) | (key != key[-1]))
            if not len(change):
                continue  # the last list may go on in the next batch
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = len(whole[0]) - (len(which) - int(change[-1]) - 1)
            out, held = links(*(x[:cut] for x in whole)), [[x[cut:] for x in whole]]
            if out is not None:
                yield out
        if held:
            out = links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if out is not None:
                yield out

    return run


def links(fps: DataFrame, most: int = 2, shared: int | None = None) -> DataFrame:
    """Links a, b between the distinct fingerprints in `fps` (column fp) such that connected fingerprints are those connected
    by steps of at most `most` differing bits (0 to 2). With `shared`, steps also share so many positional bytes, and `most` may be larger;
    up to BYTES - shared bits no step is missed."""
    shared = BYTES - most if shared is None else shared
    lists = _lists(shared)
    postings = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col("fp").bitwiseAND(int(m.astype(np.int64))).alias("key")) for k, m in lists))).alias("at"))
    postings = postings.select(F.col("at.which").alias("which"), F.col("at.key").alias("key"), "fp")
    n = parts(fps.sparkSession)
    return postings.repartition(n, "which", "key").sortWithinPartitions("which", "key").mapInArrow(_link(most, shared), "a long, b long").distinct()


def _classes(marked: DataFrame, most: int) -> DataFrame:
    """fp and component, the least connected fingerprint."""
    fps = written(marked.select("fp").distinct(), "simhash-nodes")
    label = components(links(fps, most))  # only fingerprints with links
    return written(fps.join(label, fps.fp == label.node, "left").select("fp", F.coalesce("component", "fp").alias("component")), "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Equal fingerprints are linked; documents without words have fingerprint zero and are linked like
    others. A null doc_id gets a component like any row, but is never a smallest id unless no other
    row is reachable (then null). Repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "simhash")
    labelled = written(marked.join(_classes(marked, most), "fp").select("doc_id", "fp", "component"), "simhash-labels")
    least = written(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    return labelled.join(least, "component").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates, as keep_first says. Documents without words are alike; null text
    counts as empty; columns of any name stay as they are; an empty table gives an empty one."""
    marked = written(fingerprints(docs, width=width), "simhash")
    return keep_first(docs, written(marked.join(_classes(marked, most), "fp").select("doc_id", "text_key", "component"), "simhash-labels"))


def keep_first(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each component; labelled has doc_id, text_key and component of every row.

    The row with the smallest doc_id stays (a null id comes last, ties go to the least hash of the text). Of rows that repeat
    both id and text the one with the least hash over all columns stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    least = written(labelled.groupBy("component").agg(first.alias("r")).select("component", F.col("r.doc_id").alias("keep_id"), F.col("r.text_key").alias("keep_key")), "simhash-least")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))
    judged = written(labelled.join(least, "component").groupBy("doc_id", "text_key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "simhash-judged")
    doc, key, row = (unused(c, docs) for c in ("doc", "key", "row"))
    named = lambda df: df.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    text_key = F.xxhash64(F.col("text").cast("string").cast("binary"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & text_key.eqNullSafe(F.col(key))
    goes, repeated = written(named(judged.where(~F.col("stays"))), "simhash-goes"), written(named(judged.where(F.col("stays") & (F.col("n") > 1))), "simhash-repeated")
    asked = may_be_in(goes.union(repeated), key, text_key)
    sure, kept = docs.where(~asked), docs.where(asked).join(goes, same, "left_anti")
    if repeated.isEmpty():
        return sure.unionByName(kept)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = kept.join(repeated, same, "left_semi").select(F.col("doc_id").alias(doc), text_key.alias(key), whole.alias(row))
    one = held.groupBy(doc, key).agg(F.min_by(row, F.xxhash64(F.to_json(F.col(row)))).alias(row)).select(f"{row}.*")
    return sure.unionByName(kept.join(repeated, same, "left_anti")).unionByName(one)
