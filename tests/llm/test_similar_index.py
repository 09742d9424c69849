import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import similar, simhash

from .conftest import SF, pairs
from .test_similar import near_rows, shingles


def close(a, b, most, shared):
    return (int(a) ^ int(b)).bit_count() <= most and sum(x == y for x, y in zip(int(a).to_bytes(8), int(b).to_bytes(8), strict=True)) >= shared


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("least_bits", [4096, 8])
def test_forest_connects_what_shares_bytes(monkeypatch, least_bits):
    monkeypatch.setattr(simhash, "LEAST_BITS", least_bits)
    rng = random.Random(3)
    values = list({a ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 14))) & (1 << 64) - 1 for a in (rng.getrandbits(64) for _ in range(8)) for _ in range(25)})
    forest = list(simhash._forest(np.array(values, np.uint64), 12, 4))
    assert all(close(values[a], values[b], 12, 4) for a, b in forest)
    want = groups(len(values), ((a, b) for a, b in itertools.combinations(range(len(values)), 2) if close(values[a], values[b], 12, 4)))
    assert groups(len(values), forest) == want and len(forest) == len(values) - len(set(want))


def test_candidates_of_the_stage_come_from_the_index(spark, monkeypatch):
    """The byte-position index gives the stage candidates, which alone connect over a third of these documents, all at the bound or near it."""
    found = []
    by_fingerprint = similar._by_fingerprint
    monkeypatch.setattr(similar, "_by_fingerprint", lambda sketches: found.append((sketches, by_fingerprint(sketches))) or found[-1][1])
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    kept = {d for d, _ in pairs(corpus_pipeline.drop_near_duplicates(spark, docs, SF))}
    (sketches, candidates), *_ = found
    fps = {r.node: r.fp for r in sketches.select("node", "fp").collect()}
    got = {(r.a, r.b) for r in candidates.collect()}
    assert all(close(fps[a] & (1 << 64) - 1, fps[b] & (1 << 64) - 1, similar.MOST, similar.SHARED) for a, b in got)
    sets = {similar._node(similar.shingle_set(t.encode())): shingles(t) for _, t in near_rows()}
    linked = {x for p in got if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.8 for x in p}
    near = {x for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.8 for x in p}
    assert 3 * len(linked) > len(near) > 0 and len(kept) < docs.count()
