import hashlib
import random
import re
from collections import Counter

import pytest
from oracle import compare
from pyspark.sql import functions as F

from quire.llm import decontamination, licenses, pii, queries, toxicity, words

from .conftest import SF, pairs


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


def test_every_query_is_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


# --- toxicity


def test_folding():
    assert toxicity.fold("1D10T! іdіot m0r0n $tupid 2024 B2") == "idiot! idiot moron stupid 2024 b2"


def test_hits():
    m = toxicity.Matcher({"idiot ": 1.0, "trash ": 1.0, "vequ": 2.0})
    texts = {"an idiot": 1, "idiots": 0, "a trash can of trash": 1, "vequi vequ revequi": 2, "an idi0t.": 1, "": 0}
    assert {t: m.total(toxicity.fold(t)) for t in texts} == texts


def toxic_corpus(spark, n=900):
    rng = random.Random(1)
    words_ = ["".join(rng.choice("aeioulrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words_) for _ in range(rng.randint(5, 80))]
        bad = k % 6 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "m0r0n", "zorkq" + rng.choice("abcde") * 2, "zorkq" + rng.choice(words_)]))
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.score_corpus(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 740 <= kept.count() <= 760


def test_scores_of_hard_rows(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_corpus(hard, none)
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, _ in pairs(hard))
    assert got.where("score is null or score < 0 or score > 1 or held_out is null or predicted <> 0").count() == 0
    assert toxicity.score_corpus(empty, none).count() == 0


def test_copies_do_not_teach_innocent_words():
    covered = {"bad ": set(range(60)), "once ": set(range(40)), "rare": {1, 2}}
    assert toxicity.choose_terms(covered, 60, dict.fromkeys(covered, 0.0))[0] == "bad "


# --- personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_patterns_equal_their_plain_forms():
    rng = random.Random(2)
    parts = [*"a.@-+%_ ()é", "1", "22", "333", "1.2.3.4", "4111 1111 1111 1111", "a@b.co", "+1 (234) 567-8901", "..", "--", "x@y"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("1." * 100_000) is not None


def test_found_data(hard, empty):
    want = Counter()
    for d, t in pairs(hard):
        spans = plain_spans(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want[d, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()] += 1
    got = pii.find(hard)
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert pii.find(empty).count() == 0
    assert pii.clean(hard).columns == hard.columns and pii.clean(hard).count() == hard.count()


def test_revealing_terms(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(noise) for _ in range(n))
    rows = [(k, f"{some(5)} Zorblatt wrote bob@corp.example on monday {some(5)}") for k in range(6)]
    copy = f"{some(9)} quuxcorp ann@corp.example {some(9)}"
    rows += [(10 + k, copy) for k in range(5)] + [(20 + k, some(30)) for k in range(80)] + [(200, "monday " + some(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.doc_id: {(x.entity, x.term) for x in r.reveals} for r in pii.revealing_terms(df).collect()}
    assert set(told) == set(range(6)) and all(("email:bob@corp.example", "zorblatt") in t for t in told.values())  # copies are no evidence
    texts = dict(map(tuple, pii.clean(df).collect()))
    assert "Zorblatt" not in texts[0] and "[EMAIL]" in texts[0] and "[DAY]" in texts[0]
    assert texts[10] == copy.replace("ann@corp.example", "[EMAIL]") and texts[200] == rows[-1][1] and texts[20] == rows[11][1]


# --- benchmark items


def shingles(text):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def test_leaks_equal_brute_force(spark, hard, empty):
    rng = random.Random(8)
    docs = pairs(hard)
    items = []
    for k in range(60):
        ws = rng.choice([t for _, t in docs if t and t.split()]).split()
        at = rng.randrange(len(ws))
        cut = ws[at : at + rng.randint(3, 40)]
        for _ in range(rng.randint(0, 2)):
            cut[rng.randrange(len(cut))] = "changed"
        items.append((k, " ".join(cut)))
    items += [(60, None), (61, ""), (None, items[0][1]), (5, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for d, t in docs:
        for i, x in items:
            s = shingles(x)
            if s and len(s & shingles(t)) / len(s) >= 0.8:
                want[d, i] = max(want.get((d, i), (0,)), (len(s & shingles(t)) / len(s), len(s & shingles(t)), len(s)))
    got = {(r.doc_id, r.item_id): (r.containment, r.shared, r.n_shingles) for r in decontamination.leaks(hard, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontamination.drop_leaks(hard, bench)
    assert kept.columns == hard.columns and Counter(d for d, _ in pairs(kept)) == Counter(d for d, _ in docs if d not in {x for x, _ in want})
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(hard, bench.limit(0)).count() == 0


def test_sketches_are_long_enough(spark):
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n + 4))) for n in (1, 2, 4, 5, 7, 8, 20, 63, 64)], "item_id long, text string")
    sizes = {r.item_id: r["count"] for r in decontamination.sketches(items, 5, 0.8).groupBy("item_id").count().collect()}
    assert all(min(n, n // 5 + 1) <= sizes[n] for n in sizes)


# --- licences


def test_scan_and_inheritance(spark, hard, empty):
    noise = "\n".join(f"word{k} other{k % 7} thing{k % 11} the of and" for k in range(200))
    rows = [
        (1, "p/LICENSE", "Released under the MIT License.\n" + noise),
        (2, "p/a/b/x.py", "nothing here"),
        (3, "p/a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "q/z.py", None),
        (5, "p/a/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (6, None, "code"),
        (7, "p/a/y.py", "repeated path"),
    ]
    got = {r.id: (r.license, r.found) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("GPL-3.0", "inherited"), 3: ("Apache-2.0", "header"), 4: (None, None), 5: ("GPL-3.0", "header"), 6: (None, None), 7: ("Apache-2.0", "header")}
    files = licenses.document_files(hard)
    assert licenses.scan(files).count() == hard.count() and licenses.scan(licenses.document_files(empty)).count() == 0


def test_no_python_in_native_plans(spark, hard):
    for df in (decontamination.leaks(hard, hard.select(F.col("doc_id").alias("item_id"), "text")), licenses.scan(licenses.document_files(hard))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_words_keep_order(spark):
    df = spark.createDataFrame([("  The, quick—brown 42 foxes! ",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(words.words(F.col("t")).alias("w")).collect()] == [["the", "quick", "brown", "42", "foxes"], None, []]
