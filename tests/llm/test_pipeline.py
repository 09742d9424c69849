import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import decontamination, pii, simhash, toxicity
from quire.llm.store import table

from .conftest import SF, pairs


def test_stages_do_their_work(spark):
    """Every stage against what its operator says about its own input."""
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).persist())
        assert name == corpus_pipeline.STAGES[-1][0] or kept[-1].columns == columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    model = toxicity.learn(docs, table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where(F.col("score") >= toxicity.THRESHOLD).collect()}
    assert bad and ids[1] == ids[0] - bad
    near = simhash.near_duplicates(kept[1]).collect()
    assert ids[2] == {r.component_id for r in near} < ids[1]
    leaking = {r.doc_id for r in decontamination.leaks(kept[2], table(spark, SF, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaking
    assert ids[4] == ids[3] and all(not pii.base_spans(t) for _, t in pairs(kept[4]))
    before = dict(pairs(kept[3]))
    assert all(t == before[d] for d, t in pairs(kept[4]) if not pii.base_spans(before[d]))
    got = {r.doc_id: r.decoded_sha256 for r in kept[5].collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in pairs(kept[4])}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == got
