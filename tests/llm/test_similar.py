import random
from collections import Counter

import corpus_pipeline

from quire.llm import similar

from .conftest import SF, pairs


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(b" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)) or frozenset([b" ".join(ws)])


def kept(docs):
    """doc_ids that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    return Counter(None if none else d for none, d in least.values())


def near_rows():
    """Copies around the bound of 0.8, chains, and documents that share a frequent line."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    line = [rng.choice(words) for _ in range(30)]
    rows = []
    for k in range(60):
        ws = [rng.choice(words) for _ in range(rng.randint(10, 120))] + line * (k % 3 == 0)
        for _ in range(4):
            rows.append((len(rows), " ".join(ws)))
            ws = list(ws)
            for _ in range(rng.randint(0, 1 + len(ws) // 40)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
    return rows


def test_stage_equals_brute_force(spark, hard, empty):
    near = spark.createDataFrame(near_rows(), "doc_id long, text string")
    for docs in (near, hard, spark.read.parquet(f"{SF}/documents.parquet")):
        got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        assert got.columns == docs.columns
        assert Counter(d for d, _ in pairs(got)) == kept(pairs(docs))
    assert similar.drop_similar(empty).count() == 0
