from quire.llm import decontamination


def test_every_row_of_an_id_is_found(spark):
    """A document that holds one short row among many of the same or of no id."""
    rows = [(k % 2 or None, " ".join(f"w{k}x{j}" for j in range(5 + k % 3))) for k in range(120)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"some words before {t} and after") for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(k, i, 1.0) for k, (i, _) in enumerate(rows)}
