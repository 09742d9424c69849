"""Personal data: patterns for four kinds, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. An entity is a distinct value of
these. Terms are all words outside mentions, of any length and anywhere in a document with a mention. The corpus
tells how much of an entity's information a term carries: with N different texts, df(e), df(t) and df(e, t)
of them holding the entity, the term, and both, PMI = log(df(e,t) N / (df(e) df(t))) of the information content
log(N / df(e)) is disclosed. No pair is left out. Where df(e, t) is under SUPPORT, PMI is smoothed: one more text with only the
entity and one with only the term are supposed (df + 1). Copies of one text are no evidence, so they count
once; texts are told apart by a 64-bit hash. A term that discloses at least DISCLOSURE is generalised where a broader word
fits and removed elsewhere, in every document that mentions the entity. Documents without a mention are never changed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .store import BITS, key_bits, released, unused, written

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE, SUPPORT = 0.8, 3
#: Terms that a task counts before it passes the counts on; most frequent terms whose counts are broadcast.
BLOCK, FREQUENT = 200_000, 50_000

# Fixed patterns. Possessive repeats and look-behinds keep them linear without changing the matches.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
#: Broader words for a term: fixed values.
BROADER = {
    "[MONTH]": "january february march april may june july august september october november december".split(),
    "[DAY]": "monday tuesday wednesday thursday friday saturday sunday".split(),
    "[ROLE]": "director manager engineer doctor nurse teacher lawyer officer president secretary".split(),
    "[PLACE]": "street avenue road square city town village county province".split(),
}
_BROADER = {w: k for k, ws in BROADER.items() for w in ws}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def entity(kind: int, value: str) -> str:
    """The value that mentions of one entity share."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(_DIGIT.findall(value))}"


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words (term, start, end) of a text that touch no mention."""
    taken = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in _WORD.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if k < 0 or ends[k] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def added_spans(text: str, spans: list[tuple[int, int, int]], revealing: dict[str, set[str]]) -> list[tuple[int, int]]:
    told = set().union(*(revealing.get(entity(k, text[a:b]), ()) for k, a, b in spans))
    return [(a, b) for t, a, b in words_outside(text, spans) if t in told] if told else []


def sanitise(text: str, base: list[tuple[int, int, int]], added: list[tuple[int, int]]) -> str:
    """The text with mentions replaced by their kinds and revealing terms generalised or removed. Where spans overlap, the first one counts."""
    marks = sorted([(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base] + [(a, b, _BROADER.get(text[a:b].lower(), "[REMOVED]")) for a, b in added])
    out, at = [], 0
    for a, b, mark in marks:
        if a >= at:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


SEEN = "term string, n long, text_key long, entities array<string>, terms array<string>, text string"


def _counts(repeated: np.ndarray | None):
    """Rows of three kinds: term and n, the number of texts that hold it; text_key, entities and terms of every text with a mention;
    and text_key and text, once a task, of texts that may have copies, which are not counted yet."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("text_key", pa.int64()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("text", pa.string())])

    def rows(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        sent: set[int] = set()

        def counted() -> Iterator[pa.RecordBatch]:
            names = list(counts)
            for k in range(0, len(names), 20_000):
                here = names[k : k + 20_000]
                yield rows(term=here, n=[counts[t] for t in here])

        for b in batches:
            found = [[], [], []]
            for text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if repeated is not None and repeated[key % BITS >> 3] >> (key % 8) & 1:
                    if key not in sent:
                        sent.add(key)
                        yield rows(text_key=[key], text=[text])
                    continue
                spans = base_spans(text)
                terms = {t for t, _, _ in words_outside(text, spans)} if spans else {t.lower() for t in set(_WORD.findall(text))}
                for t in terms:
                    counts[t] = counts.get(t, 0) + 1
                if spans:
                    for c, v in zip(found, (key, sorted({entity(k, text[x:y]) for k, x, y in spans}), sorted(terms)), strict=True):
                        c.append(v)
                if len(counts) > BLOCK:
                    yield from counted()
                    counts.clear()
            if found[0]:
                yield rows(text_key=found[0], entities=found[1], terms=found[2])
        yield from counted()

    return run


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _reveals_by_text(plain: DataFrame) -> DataFrame:
    """text_key, reveals: the entities of each different text with its terms that give them away; only texts that have such."""
    spark = plain.sparkSession
    keys = written(plain.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")), "pii-texts")
    total = keys.count()
    # Copies are no evidence. The bits say which texts may have some; those, few unless the corpus is all copies, are made one before they are counted.
    repeated = spark.sparkContext.broadcast(key_bits(keys.where("copies > 1"), "text_key"))
    texts = plain.select("text", "text_key")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(_counts(repeated.value)(batches))

    once = written(texts.mapInArrow(first, SEEN), "pii-counts")
    copied = once.where("text is not null").select("text", "text_key").dropDuplicates(["text_key"])
    seen = once.where("text is null").unionByName(written(copied.mapInArrow(_counts(None), SEEN), "pii-copied"))
    df_term = written(seen.where("term is not null").groupBy("term").agg(F.sum("n").alias("df_t")), "pii-term-texts")
    held = seen.where("text_key is not null")
    entities = held.select("text_key", F.explode("entities").alias("entity"))
    df_entity = written(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e")), "pii-entity-texts")
    known = entities.join(df_entity, "entity").groupBy("text_key").agg(F.collect_list(F.struct("entity", "df_e")).alias("es"))
    full = written(held.select("text_key", "terms").join(known, "text_key"), "pii-held")

    def telling(both):
        plain_, one_more = ((F.col("df_e") + k) * (F.col("df_t") + k) for k in (0, 1))
        pmi = F.ln(both * F.lit(float(total)) / F.when(both >= SUPPORT, plain_).otherwise(one_more))
        return (F.col("df_e") < total) & (pmi / F.ln(F.lit(float(total)) / F.col("df_e")) >= DISCLOSURE)

    # Both are in as many texts as the rarer one at most: pairs that cannot disclose enough even then go before they are
    # moved, at once for the most frequent terms, which are most of the words, after a join for the others.
    top = written(df_term.orderBy(F.desc("df_t"), "term").limit(FREQUENT), "pii-frequent")  # FREQUENT rows at most
    words = full.select("text_key", "es", F.explode("terms").alias("term")).join(F.broadcast(top), "term", "left")
    each = lambda df, *more: df.select("text_key", "term", F.explode("es").alias("e"), *more).select("text_key", "term", "e.entity", "e.df_e", *more)
    frequent = each(words.where("df_t is not null"), "df_t")
    rare = each(words.where("df_t is null")).join(df_term, "term")
    pairs = written(frequent.unionByName(rare).where(telling(F.least("df_e", "df_t"))), "pii-pairs")
    counted = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.first("df_e").alias("df_e"), F.first("df_t").alias("df_t"))
    told = written(counted.where(telling(F.col("both"))).select("entity", "term"), "pii-telling")
    return written(pairs.join(told, ["entity", "term"], "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("entity", "term")).alias("reveals")), "pii-reveals")


def revealing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, reveals: the entities of each row with the terms that give them away; only rows that have such.

    All counts cover all different texts; rows with the same text have the same answer, whatever their ids.
    """
    plain = _plain(docs, id_col, text_col)
    return plain.select("doc_id", "text_key").join(_reveals_by_text(plain), "text_key").select("doc_id", "reveals")


def _revealing(reveals: list | None) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for r in reveals or ():
        out.setdefault(r["entity"], set()).add(r["term"])
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string"


def _found(rows: Iterator[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
    """rows: text, its base spans and its added spans, for the rows of b."""
    counts, shas, spans, clean = [[] for _ in KINDS], [], [], []
    for text, base, added in rows:
        for k, c in enumerate(counts):
            c.append(sum(s[0] == k for s in base))
        listed = ",".join(f"{KINDS[k]}:{x}:{y}" for k, x, y in base)
        shas.append(hashlib.sha256(listed.encode()).hexdigest())
        spans.append(",".join(filter(None, [listed, *(f"term:{x}:{y}" for x, y in added)])))
        clean.append(sanitise(text, base, added) if base else text)
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised"])


def _with_mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([bool(base_spans(t)) for t in b.column("text").to_pylist()], pa.bool_()))


def _without_mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = b.filter(pa.array([not base_spans(t) for t in b.column("text").to_pylist()], pa.bool_()))
        yield _found(((t, [], []) for t in rest.column("text").to_pylist()), rest)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(text: str, told: list | None) -> tuple:
        base = base_spans(text)
        return text, base, added_spans(text, base, _revealing(told)) if told else []

    for b in batches:
        yield _found((spans(t, told) for t, told in zip(b.column("text").to_pylist(), b.column("reveals").to_pylist(), strict=True)), b)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised of every row.

    spans: kind:start:end of the pattern matches by kind and start, then of the added spans (kind
    `term`). Null text counts as empty; long texts are read whole. Each row is judged by its text alone: repeated rows, rows
    that share an id and rows with a null id each give their own row; other columns, whatever their names, are ignored; an
    empty table gives none. Only texts with a mention are joined with what the corpus tells.
    """
    plain = _plain(docs, id_col, text_col)
    reveals = _reveals_by_text(plain)
    mentioned = plain.mapInArrow(_with_mentions, plain.schema).join(reveals, "text_key", "left").select("doc_id", "text", "reveals")
    return plain.mapInArrow(_without_mentions, FOUND).unionByName(mentioned.mapInArrow(_told, FOUND))


@F.arrow_udf(BooleanType())
def _mentions(text: pa.Array) -> pa.Array:
    return pa.array([bool(t) and bool(base_spans(t)) for t in text.to_pylist()], pa.bool_())


@F.arrow_udf(StringType())
def _scrub(text: pa.Array, told: pa.Array) -> pa.Array:
    out = []
    for t, r in zip(text.to_pylist(), told.to_pylist(), strict=True):
        base = base_spans(t)
        out.append(sanitise(t, base, added_spans(t, base, _revealing(r))))
    return pa.array(out, pa.string())


def clean(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with sanitised texts; n_chars, where there is such a column, follows the text.

    Null texts stay null, empty ones empty; rows with the same text get the same text, whatever their ids; columns of any other
    name stay as they are; an empty table gives an empty one.
    """
    text = F.col("text").cast("string")
    reveals = _reveals_by_text(_plain(docs, "doc_id", "text"))
    key, told = unused("text_key", docs), unused("reveals", docs)
    reveals = reveals.select(F.col("text_key").alias(key), F.col("reveals").alias(told))
    named = docs.withColumn("text", text)
    without = named.where(~_mentions("text"))
    # A broadcast would put both Python steps into one task, and so two workers beside each other on every core; they stay and keep their memory.
    mentioned = named.where(_mentions("text")).withColumn(key, F.xxhash64("text")).join(reveals.hint("merge"), key, "left").withColumn("text", _scrub("text", told)).select(docs.columns)
    out = without.unionByName(mentioned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
