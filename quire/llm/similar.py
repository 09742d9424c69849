"""Near-duplicates by exact Jaccard similarity of word shingles.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8. Candidates come from SimHash
fingerprints of these sets, through the byte-position inverted index of simhash.py: pairs that share at least SHARED of the eight positional bytes by
count, and differ in at most MOST bits, of which every list gives a spanning forest. The exact similarity is then verified, and what is linked
is one class. Pairs of that similarity may differ in more bits and bytes than any index of use allows, so
an exact search for links between the classes follows.

It works without loss: shingles have one order, rare ones first. If two
sets are that similar, the first fifth of each (and one more) share a shingle, so a list is made of every such shingle. On
a list, a pair is dropped if its sizes, or the places of the shingle in the two orders, rule the similarity out. What is left is
verified with the whole sets. The order takes its frequencies from a sample; any order gives the same pairs, a
poor one only longer lists.

Only groups are wanted, so a group of n near copies is not expanded into its pairs. Every member of a list is first compared
with a few members alone, the same ones in most lists of a group, unless SimHash has put both into one class. Whom that links is one class, too; then, in lists of more than three,
members that are not of the class of the first member are compared with all the others, which finds every link between classes.
Sketches of parity bits rule out most pairs: two sets differ in at least as many shingles as their sketches in bits.
Lists pass through a task in order, a few members held at a time; those of shingles that are frequent in the sample are joined
instead. Texts are never shuffled: only those of pairs that are left are made sets again. Shingle sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import SEED, keep_first, links, majority, shingle_hashes
from .store import BITS, give_back, key_bits, parts, released, written

WIDTH = 5
#: Bits that the fingerprints of a candidate differ in at most, positional bytes that they share at least.
MOST, SHARED = 12, 4
#: Documents that the frequencies are taken from, and the most shingles that are known by frequency (16 bytes each, broadcast).
SAMPLE, KNOWN = 20_000, 200_000
#: Documents of the sample from which a shingle counts as frequent; members that the others of such a list are first compared with.
OFTEN, PIVOTS = 40, 24
#: Columns of a sketch, 64 parity bits each.
SKETCH = tuple(f"p{k}" for k in range(16))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the shingles, sorted. A text of fewer words is one shingle, one without words the empty shingle."""
    return np.unique(np.array(shingle_hashes(text or b"", WIDTH) or [xxhash.xxh64_intdigest(b"", SEED)], np.uint64)).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and how many documents of the sample hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                sets = [shingle_set(text) for text in b.column(0).slice(k, 128).to_pylist()]
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    top = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    top.sort(key=lambda r: r.h)
    return np.array([r.h for r in top], np.int64), np.array([r.n for r in top], np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of 1,024 parts of the hash range, whether the set has an odd number of hashes there."""
    parts = (s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(parts, minlength=64 * len(SKETCH)) & 1).view(np.int64)


def _mark(known: tuple[np.ndarray, np.ndarray]):
    """doc_id, text_key, node (the set's name), n (its size), fp (its fingerprint), its sketch and the start of its order, n - ceil(0.8 n) + 1 shingles; a task
    gives the last once for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = known.value
        sent: set[int] = set()
        for b in batches:
            nodes, sizes, fps, firsts, bits = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text)
                n = len(s)
                nodes.append(node := _node(s))
                sizes.append(n)
                fps.append(majority(s))
                bits.append(sketch(s))
                if node in sent:
                    firsts.append(None)
                    continue
                sent.add(node)
                weight = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    weight = np.where(often[at] == s, counts[at], 0)
                firsts.append(s[np.argsort(weight, kind="stable")][: n + (-4 * n // 5) + 1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(firsts, pa.list_(pa.int64())), *map(pa.array, np.array(bits, np.int64).reshape(-1, len(SKETCH)).T)], names=["doc_id", "text_key", "node", "n", "fp", "first", *SKETCH])

    return run


def _sets(bits):
    """node and s, the set, of the texts whose key has its bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.mod(b.column("text_key").to_numpy(), BITS)
            some = b.column("text").filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for k in range(0, len(some), 256):
                sets = [shingle_set(t) for t in some.slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return run


PAIRS = "a long, b long, h long, node long, n int, place int"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by h and a hash of the node: the pairs a, b that sizes and places allow of every list's members with
    the first two and the one before, and the members (h, node, n, place) of lists of more than three. Repeated members count once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.int64() if c in ("h", "node") else pa.int32()) for c in ("h", "node", "n", "place"))])
    at, size, last, first, before = None, 0, None, [], None  # of the list that may go on in the next batch
    for b in batches:
        h, node, n, place = (b.column(c).to_numpy() for c in ("h", "node", "n", "place"))
        many = np.zeros(len(h), bool)
        if len(h):
            many[1:] = h[1:] == h[:-1]
            many[:-1] |= many[1:]
            many[0] |= h[0] == at
            many[-1] = True  # it may have company in the next batch
        pairs, members = [], []
        where = np.flatnonzero(many)
        for x in zip(h[where].tolist(), node[where].tolist(), n[where].tolist(), place[where].tolist(), strict=True):
            if x[0] != at:
                at, size, last, first = x[0], 0, None, []
            if x[1] == last:
                continue
            last, size = x[1], size + 1
            for y in (*first[:2], before) if size > 3 else first:
                small, large = (x[2], y[2]) if x[2] < y[2] else (y[2], x[2])
                if 5 * small >= 4 * large and 9 * min(x[2] - x[3], y[2] - y[3]) >= 4 * (x[2] + y[2]):
                    pairs.append((min(x[1], y[1]), max(x[1], y[1])))
            before = x
            if size <= 3:
                first.append(x)
            elif size == 4:
                members += [*first, x]
            else:
                members.append(x)
        if pairs or members:
            none = [None] * len(members)
            columns = [[p[0] for p in pairs] + none, [p[1] for p in pairs] + none, *([None] * len(pairs) + [m[k] for m in members] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _possible(x: str, y: str):
    """Sizes and places of two members of a list allow a similarity of 0.8."""
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - p, m - q) >= 4 * (n + m))


def _close(x: str, y: str):
    """Sizes and sketches of two sets allow a similarity of 0.8."""
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in SKETCH), F.lit(0))
    return 9 * differ <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _sketches(marked: DataFrame) -> DataFrame:
    """node, n, fingerprint and sketch, a row a set."""
    return marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", *SKETCH)))


def _by_fingerprint(sketches: DataFrame) -> DataFrame:
    """Pairs a, b of sets that the byte-position index links; sets with one fingerprint are paired with the least of them."""
    least = written(sketches.groupBy("fp").agg(F.min("node").alias("least")), "similar-fps")
    near = written(links(least.select("fp"), MOST, SHARED), "similar-fp-links")
    a, b = (least.select(F.col("fp").alias(k), F.col("least").alias(f"n{k}")) for k in "ab")
    apart = near.join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return apart.union(sketches.select("fp", "node").join(least, "fp").where("node <> least").select("least", "node"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _whole(nodes: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """node and s, the whole set, of every node."""
    one = written(marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key"), "similar-one")
    # Null and empty texts have no pairs. Repeated texts give the same set, once for each until they are made one. One Python step a task.
    bits = texts.sparkSession.sparkContext.broadcast(key_bits(one, "text_key"))
    whole = texts.select("text", "text_key").mapInArrow(lambda batches: released(_sets(bits)(batches)), "node long, s array<long>")
    return written(whole.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), "similar-set")


def _more(nodes: DataFrame, whole: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """whole, and the sets of those of the nodes that it lacks."""
    lacking = written(nodes.join(whole, "node", "left_anti"), "similar-nodes")
    return whole if lacking.isEmpty() else whole.union(_whole(lacking, texts, marked))


def _allowed(pairs: DataFrame, sketches: DataFrame, *apart: str) -> DataFrame:
    """Those of the pairs a, b whose sizes and sketches allow a similarity of 0.8, and that differ in the columns apart."""
    x, y = (sketches.select(F.col("node").alias(k), F.struct("n", *apart, *SKETCH).alias(s)) for k, s in ("ax", "by"))
    differ = [F.col(f"x.{c}") != F.col(f"y.{c}") for c in apart]
    return pairs.join(x, "a").join(y, "b").where(reduce(and_, differ, _close("x", "y"))).select("a", "b")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs a, b of sets whose Jaccard similarity is at least 0.8."""
    left, right = (whole.select(F.col("node").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(shared * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


def classes(texts: DataFrame, marked: DataFrame, frequent: list[int]) -> DataFrame:
    """node and component of the shingle sets that are connected with others by steps of a Jaccard similarity of at least 0.8.
    frequent: shingles whose lists may be too long for one task, KNOWN at most."""
    spark = texts.sparkSession
    give_back(spark)
    sketches = written(_sketches(marked), "similar-sketches")
    pairs = written(_allowed(_by_fingerprint(sketches), sketches), "similar-fp-pairs")
    whole = _whole(written(_ends(pairs), "similar-nodes"), texts, marked)
    linked = written(_verified(pairs, whole), "similar-linked")
    label = written(components(linked), "similar-classes")
    sketches = written(sketches.drop("fp").join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "similar-sketches")

    give_back(spark)
    order = F.xxhash64("node")
    members = marked.where("first is not null").select("node", "n", F.posexplode("first").alias("place", "h"))
    hot = F.broadcast(spark.createDataFrame([(h,) for h in frequent], "h long"))
    rare = members.join(hot, "h", "left_anti").repartition(parts(spark), "h").sortWithinPartitions("h", order, "node")
    walked = written(rare.select("h", "node", "n", "place").mapInArrow(_walk, PAIRS), "similar-walked")
    often = written(members.join(hot, "h", "left_semi").groupBy("h", "node").agg(F.first("n").alias("n"), F.first("place").alias("place")), "similar-often")
    ends = [f(F.struct(F.xxhash64("node", F.lit(k)).alias("k"), "node", "n", "place")) for f in (F.min, F.max) for k in range(PIVOTS // 2)]
    pivots = written(often.groupBy("h").agg(F.array_distinct(F.transform(F.array(*ends), lambda x: F.struct(x.node.alias("node"), x.n.alias("n"), x.place.alias("place")))).alias("xs")).select("h", F.explode("xs").alias("x")), "similar-pivots")
    near = often.select("h", F.struct("node", "n", "place").alias("y")).join(pivots, "h").where((F.col("x.node") != F.col("y.node")) & _possible("x", "y"))
    pairs = written(walked.where("a is not null").select("a", "b").distinct().union(_distinct(near)).distinct(), "similar-pairs")
    pairs = written(_allowed(pairs, sketches, "class"), "similar-first-pairs")
    nodes = written(_ends(pairs), "similar-nodes")
    whole = _more(nodes, whole, texts, marked)
    give_back(spark)
    first = linked.union(_verified(pairs, whole.join(nodes, "node", "left_semi")))
    label = written(components(first), "similar-classes")
    long = walked.where("h is not null").select("h", "node", "n", "place").union(often.select("h", "node", "n", "place"))
    classed = written(long.join(label, "node", "left").select("h", "node", "n", "place", F.coalesce("component", "node").alias("class")), "similar-classed")
    head = F.min(F.struct(order.alias("k"), F.col("class").alias("main")))
    mixed = written(classed.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high"), head.alias("m")).where("low < high").select("h", "m.main"), "similar-main")
    there = classed.join(mixed, "h").join(sketches.drop("n", "class"), "node")
    there = written(there.select("h", "main", F.struct("node", "n", "place", "class", *SKETCH).alias("y")), "similar-mixed")
    others = there.where(F.col("y.class") != F.col("main")).select("h", F.col("y").alias("x"))
    apart = (F.col("x.class") != F.col("y.class")) & ((F.col("y.class") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
    rest = there.join(others, "h").where(apart & _possible("x", "y") & _close("x", "y"))
    pairs = written(_distinct(rest), "similar-rest-pairs")
    if pairs.isEmpty():
        return label
    nodes = written(_ends(pairs), "similar-nodes")
    found = _verified(pairs, _more(nodes, whole, texts, marked).join(nodes, "node", "left_semi"))
    return components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group of linked documents the row with the smallest doc_id
    stays, as simhash.keep_first says. Documents without words, null texts among them, are alike."""
    texts = _texts(docs)
    shingles, counts = _frequencies(texts)
    known = docs.sparkSession.sparkContext.broadcast((shingles, counts))
    marked = written(texts.mapInArrow(lambda batches: released(_mark(known)(batches)), "doc_id long, text_key long, node long, n int, fp long, first array<long>, " + ", ".join(f"{p} long" for p in SKETCH)), "similar")
    label = classes(texts, marked, shingles[counts >= OFTEN].tolist())  # only sets with links
    labelled = marked.join(label, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    return keep_first(docs, written(labelled, "similar-labels"))
