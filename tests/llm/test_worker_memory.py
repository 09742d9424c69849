import pyarrow as pa
import public_tokenizers

from quire.llm import pieces, toxicity


def test_terms_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 10)
    rows = [(f"alpha word{k} beta", k % 2) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([y for _, y in rows], pa.int32())], names=["text", "toxic"])
    out = list(toxicity._count_terms([batch]))
    total = pa.Table.from_batches(out).group_by("term").aggregate([("clean", "sum"), ("toxic", "sum")]).to_pylist()
    assert len(out) > 1 and max(b.num_rows for b in out) <= 10 + 20
    assert {r["term"]: (r["clean_sum"], r["toxic_sum"]) for r in total}["alpha "] == (20, 20)


def test_remembered_words_have_a_bound(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 200)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        c = pieces.PieceCodec(f.read())
    for k in range(20):
        list(c.encode_batch([" ".join(f"w{k}x{j}" for j in range(90))]))
        assert len(c.ids) <= 2 * 200  # a word and its stem
    c.forget()
    assert not c.ids and not c.decimal
