"""Cases that once ended a job, lost rows or took the square of a text's length."""

import random
import struct
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, media, pii, similar, simhash, suffixdedup, toxicity

from .conftest import SF, pairs

CLASHING = ("__doc", "__key", "__reveals", "doc", "key", "row", "text_key", "reveals", "component", "node", "n", "item_id", "h")


@pytest.fixture(scope="module")
def clashing(hard):
    out = hard.drop("h")
    for c in CLASHING:
        out = out.withColumn(c, F.lit("x"))
    return out


def test_long_parts_of_an_address():
    for text, found in (("1.2.3." + "0" * 5000, [(1, 0, 5006)]), ("1.2.3." + "9" * 5000, []), ("0" * 5000 + "1.2.3.256", []), ("001.002.003.0255", [(1, 0, 16)])):
        assert pii.base_spans(text) == found


def test_personal_data_of_hard_texts(spark):
    rows = [(1, "1.2.3." + "0" * 5000), (1, None), (None, "me@corp.example"), (None, ""), (2, "x" * 100_000 + " a@b.co"), (2, "plain")]
    got = Counter((r.doc_id, r.n_email, r.n_ip) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 0, 1), (1, 0, 0), (None, 1, 0), (None, 0, 0), (2, 1, 0), (2, 0, 0)])


def test_stages_keep_columns_of_any_name(spark, clashing, empty):
    stages = [
        lambda d: toxicity.drop_toxic(d, spark.read.parquet(f"{SF}/labels.parquet")),
        simhash.drop_near_duplicates,
        similar.drop_similar,
        lambda d: decontamination.drop_leaks(d, spark.read.parquet(f"{SF}/benchmark.parquet")),
        pii.clean,
    ]
    for stage in stages:
        out = stage(clashing)
        assert out.columns == clashing.columns and 0 < out.count() <= clashing.count()
        assert out.where(" or ".join(f"`{c}` is null or `{c}` <> 'x'" for c in CLASHING)).count() == 0
        assert stage(empty).count() == 0


def test_pipeline_of_hard_rows(spark, hard, empty):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, SF).persist(), stage(spark, empty, SF)
        assert none.count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 20


def test_one_of_rows_that_repeat_id_and_text(spark):
    rows = [(1, "some words of a text that is there twice", s) for s in "cab"] + [(2, "other words that are there but once", "d")]
    kept = {spark_rows for _ in range(2) for spark_rows in [tuple(sorted(map(tuple, similar.drop_similar(spark.createDataFrame(random.sample(rows, 4), "doc_id long, text string, source string")).collect())))]}
    assert len(kept) == 1 and [r[0] for r in kept.pop()] == [1, 2]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 146, 900):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n + 1))
        b = np.unique(np.r_[a[: len(a) * 3 // 4], rng.integers(-(1 << 62), 1 << 62, n // 4 + 1)])
        bits = int(np.bitwise_count(similar.sketch(a).view(np.uint64) ^ similar.sketch(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and not (similar.sketch(a) ^ similar.sketch(a.copy())).any()


def plain_total(folded, weights, exceptions):
    """The matcher's rules, one place after another."""
    place = lambda k: k == 0 or not folded[k - 1].isalnum()
    closed = lambda e: e == len(folded) or not folded[e].isalnum()
    safe = set()
    for k in range(len(folded)):
        for p in exceptions:
            if place(k) and folded.startswith(p, k) and closed(k + len(p)):
                safe.update(range(k, k + len(p)))
    total = 0.0
    for k in range(len(folded)):
        found = [w for t, w in weights.items() if place(k) and folded.startswith(t.rstrip(" "), k) and closed(k + len(t.rstrip(" "))) == t.endswith(" ")]
        total += max(found, default=0.0) if k not in safe else 0.0
    return total


def test_matcher_equals_plain_search():
    rng = random.Random(9)
    weights = {"trash ": 1.5, "trash": 0.5, "can ": 0.25, "clown ": 2.0, "clo": 1.0, "sore": 0.75, "loser ": 3.0, "é ": 4.0}
    m = toxicity.Matcher(weights)
    parts = ["trash", "can", "clown", "fish", "sore", "loser", "s", " ", " ", ".", "é", "1", "clo", "circus", "-", "_"]
    for _ in range(4000):
        t = toxicity.fold("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert m.total(t) == pytest.approx(plain_total(t, weights, toxicity.EXCEPTIONS)), t


def test_folding_of_disguises():
    assert toxicity.fold("ｉｄｉｏｔ 𝓲𝓭𝓲𝓸𝓽 i​d̶i­ot іԁіот éclair") == "idiot idiot idiot idiot éclair"


def test_toxicity_takes_linear_time():
    start = time.time()
    m = toxicity.Matcher({"idiot ": 1.0, "trash ": 1.0})
    assert m.total(toxicity.fold("trash can idiot " * 50_000)) == 50_000
    toxicity.fold("a" * 3_000_000), toxicity.fold("é1" * 500_000)
    assert time.time() - start < 20


def test_damaged_containers(spark):
    good = media.pack(media.pad(b"abc" * 500))
    at = {k: good.index(k) + 8 for k in (b"stsz", b"stsc", b"stss", b"co64", b"stts")}
    put = lambda kind, offset, *n: good[: at[kind] + offset] + struct.pack(f">{len(n)}I", *n) + good[at[kind] + offset + 4 * len(n) :]
    bad = [put(b"stsz", 0, 0, 60_000_000), put(b"stsz", 0, 1, 4_000_000_000), put(b"stsc", 0, 4_000_000_000), put(b"stsc", 4, 2), put(b"stss", 0, 4_000_000_000), put(b"stss", 4, 0xFFFFFFF), put(b"co64", 0, 4_000_000_000), put(b"co64", 4, 1, 1), put(b"stts", 0, 4_000_000_000), good[:700], b"", struct.pack(">I4s", 0, b"moov") * 50_000]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([*bad, good])], "k int, media binary")
    got = {r.k: r.media_info for r in media.media_columns(rows).collect()}
    assert got[len(bad)].error is None and got[len(bad)].n_samples == 8
    assert all(got[k].error and got[k].n_samples is None for k in range(len(bad)))


def test_ids_at_the_end_of_the_range(spark):
    text = "a passage of well over fifty bytes that is in every one of the documents"
    rows = [(2**63 - 1, text), (None, text + " too"), (5, text)]
    got = {r.doc_id: r.n_removed for r in suffixdedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: len(text), None: len(text), 5: 0}


def test_a_head_in_every_document(spark):
    """One common line between different neighbours: all its contexts differ."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    rows = [(k, f"{word()} {word()} {line} {word()} {word()}") for k in rng.sample(range(1000), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    results = [Counter(map(tuple, suffixdedup.repeat_digest(docs, hot=hot).collect())) for hot in (suffixdedup.HOT, 20)]
    from .test_duplicates import repeats

    assert results[0] == results[1] == repeats(pairs(docs))


def test_tally_of_positional_bytes():
    differ = np.array([0, 1, 0x0101, 0xFF00FF00FF00FF00, (1 << 64) - 1], np.uint64)
    assert simhash.tally(differ).tolist() == [8, 7, 6, 4, 0]
    assert simhash._close(differ, 2).tolist() == [0, 1, 2]
