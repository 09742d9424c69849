import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import components, simhash, suffixdedup

from .conftest import SF, pairs


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values):
    """Root of each value under links of at most two bits."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(values))]


def expected(docs):
    fps = [fingerprint(t or "") for _, t in docs]
    roots = linked(fps)
    out = []
    for (d, _), f, r in zip(docs, fps, roots, strict=True):
        ids = [x for (x, _), y in zip(docs, roots, strict=True) if y == r and x is not None]
        out.append((d, f"{f:016x}", min(ids, default=None)))
    return Counter(out)


def test_near_duplicates(spark, hard, empty):
    assert Counter(map(tuple, simhash.near_duplicates(hard).collect())) == expected(pairs(hard))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected(pairs(docs))
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_component_stays(hard, empty):
    kept = simhash.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    before, after = ([fingerprint(t or "") for _, t in pairs(df)] for df in (hard, kept))
    assert len(after) == len(set(linked(after))) == len(set(linked(before)))
    assert set(expected(pairs(hard))) >= {(d, f"{f:016x}", d) for (d, _), f in zip(pairs(kept), after, strict=True)}
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", [40, 700])
def test_lists_keep_connection(n):
    rng = np.random.default_rng(n)
    low = np.unique(rng.integers(0, 1 << 14, n).astype(np.uint64)) | np.uint64(7 << 40)
    forest = list(simhash._near(low, 2))
    want = linked(low.tolist())
    parent = list(range(len(low)))
    for a, b in forest:
        assert (int(low[a]) ^ int(low[b])).bit_count() <= 2
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert [root(k) for k in range(len(low))] == want and len(forest) == len(low) - len(set(want))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(5, 2000 + k) for k in range(300)] + [(7, 7), (9, 8)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1000, 1101), 1000), 5: 5, **dict.fromkeys(range(2000, 2300), 5), 9: 8, 8: 8}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_loser_tree_shares():
    rng = random.Random(6)
    width = suffixdedup.SPAN + suffixdedup.REACH
    for runs in (0, 1, 2, 3, 7, 9):
        rows = [sorted(bytes([65] * rng.randint(0, width - 1) + [rng.randint(65, 68)] * width)[:width] for _ in range(rng.randint(0, 25))) for _ in range(runs)]
        streams = []
        for r in rows:
            shared, rest = suffixdedup.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, width))
            streams.append(suffixdedup.front_decode(shared.tolist(), rest))
        out = list(suffixdedup.LoserTree(streams)) if streams else []
        assert [t for _, t, _ in out] == sorted(t for r in rows for t in r)
        assert all(k == len(os.path.commonprefix([a[1], b[1]])) for a, b in zip(out, out[1:]) for k in [b[2]])


def repeats(docs):
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t in sorted(docs, key=lambda x: key(x[0])):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], key(d))
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key(d):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 3])
def test_repeats(spark, hard, hot):
    assert Counter(map(tuple, suffixdedup.repeat_digest(hard, hot=hot).collect())) == repeats(pairs(hard))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, suffixdedup.repeat_digest(docs, hot=hot).collect())) == repeats(pairs(docs))


def test_texts_without_repeats(hard, empty):
    left = {(r.doc_id, hashlib.sha256(r.text).hexdigest()) for r in suffixdedup.remove_repeats(hard).collect()}
    assert left == {(d, sha) for d, _, _, _, sha in repeats(pairs(hard))}
    assert suffixdedup.repeat_digest(empty).count() == 0
