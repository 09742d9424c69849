"""Corpus pipeline: five operators of quire.llm, one after the other over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents. Texts of any length are worked on whole. Every stage first lets the executors
give back the memory of what ran before it.
"""

from quire.llm import decontamination, pieces, pii, similar, toxicity
from quire.llm.queries import PIECES
from quire.llm.store import give_back, table, written


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches the threshold go. The lexicon is learned from the labelled documents that arrive.

    Null and empty texts have no hits and stay; repeated rows share the fate of their text; without labels the fixed
    lexicon counts alone; an empty table gives an empty one. Extra columns of any name pass through, here and in the next three stages.
    """
    give_back(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group stays that is linked by five-word shingles of Jaccard similarity 0.8.

    It is the one with the smallest doc_id, a null id coming last; ties go to the least hash of the text, then of the row, and repeated rows
    become one. Null texts, empty ones and those without words are one group. An empty table gives an empty one.
    """
    give_back(spark)
    return similar.drop_similar(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go: at least 0.8 of its five-word shingles.

    Null and empty texts hold none; rows that share an id, a null one too, go together; an empty table gives an empty one.
    """
    give_back(spark)
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark, docs, sf_dir):
    """Personal data and terms that reveal it are replaced in the texts, and n_chars follows; no document goes.

    Null texts stay null, empty ones empty; rows with one text get one text, whatever their ids; an empty table gives an empty one.
    """
    give_back(spark)
    return pii.clean(docs)


def encode(spark, docs, sf_dir):
    """Piece ids, digested, of every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty, which has no ids; repeated rows and rows with a null id each give a row; other columns end here; an
    empty table gives an empty one.
    """
    give_back(spark)
    return pieces.digest(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", sanitise),
    ("pieces", encode),
]
#: No stage but the third can be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
