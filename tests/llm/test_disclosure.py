import math
import random
import re

from quire.llm import pii


def brute(rows):
    """(doc_id, entity, term) by counting every pair over the different texts."""
    texts = {t for _, t in rows}
    n, facts = len(texts), {}
    for t in texts:
        entities = {m.lower() for m in re.findall(r"\S+@\S+", t)}
        facts[t] = ({f"email:{e}" for e in entities}, set(re.findall(r"[^\W\d_]+", re.sub(r"\S+@\S+", " ", t).lower())))
    out = set()
    for e in {e for es, _ in facts.values() for e in es}:
        holding = [ws for es, ws in facts.values() if e in es]
        for w in set().union(*holding):
            both, df_e, df_t = sum(w in ws for ws in holding), len(holding), sum(w in ws for _, ws in facts.values())
            more = both < 3
            if math.log(both * n / ((df_e + more) * (df_t + more))) / math.log(n / df_e) >= 0.8:
                out |= {(d, e, w) for d, t in rows if e in facts[t][0] and w in facts[t][1]}
    return out


def test_entities_of_one_or_two_mentions(spark):
    rng = random.Random(7)
    noise = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(200)]
    some = lambda n: " ".join(rng.choice(noise) for _ in range(n))
    rows = [(k, some(12)) for k in range(1200)]
    rows.append((2000, f"Xy {some(40)} solo@one.example {some(30)} Quuxcorp"))  # far from the mention, and short
    rows += [(2001 + k, f"Marvolo {some(20)} pair@two.example {some(5)}") for k in range(2)]
    rows += [(2010 + k, f"{some(9)} many@six.example zorblatt") for k in range(6)] + [(2020 + k, "vwxyz copied@copy.example") for k in range(4)]
    rows += [(2030, f"zorblatt {some(9)}"), (2031, f"{some(9)} many@six.example zorblatt solo@one.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, x.entity, x.term) for r in pii.revealing_terms(df).collect() for x in r.reveals}
    assert got == brute(rows)
    assert {(2001, "email:pair@two.example", "marvolo"), (2002, "email:pair@two.example", "marvolo"), (2020, "email:copied@copy.example", "vwxyz")} <= got
    texts = dict(map(tuple, pii.clean(df).collect()))
    assert "Marvolo" not in texts[2001] and "Xy" not in texts[2000] and "Quuxcorp" not in texts[2000] and texts[5] == rows[5][1]


def test_words_outside_mentions():
    text = "ab Anna ann@corp.example, éann@corp.example Bo"
    assert [t for t, _, _ in pii.words_outside(text, pii.base_spans(text))] == ["ab", "anna", "bo"]
