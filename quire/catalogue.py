"""The engine's named queries and, for each that SQL can express, its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import classify, layout, paragraphs, statistics
from quire.plans import documents as plans
from quire.plans import fixtures
from quire.sources import sample_pdf

_blocks, _frags = fixtures.lines_as_blocks, fixtures.words_as_fragments


def _kinds(s, d):
    return classify.with_kinds(_blocks(s, d))


def _paras(s, d):
    return plans.blocks_to_paragraphs(_blocks(s, d))


def _body(s, d):
    return paragraphs.with_continues(paragraphs.heading_context(_kinds(s, d)).where("kind = 'body'"))


def _lines(s, d):
    return layout.finish_lines(layout.with_lines(_frags(s, d)))


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _join_lines(s, d):
    docs = fixtures.documents(s, d)
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 3 == 1, F.concat(F.lit("and  "), x)).when(k % 3 == 2, F.concat(F.lit(" "), x)).otherwise(F.concat(F.regexp_replace(x, r"\.$", ""), F.lit("-"))))
    return docs.select("doc_id", fn.join_lines(lines).alias("joined"))


def _text_functions(s, d):
    t = F.col("text")
    return _blocks(s, d).select(
        "doc_id", "idx", F.length(t).cast("long").alias("n"), fn.first(t).alias("head"), fn.ends_in(t, fn.SENTENCE_END).alias("ends"), fn.first(t).rlike(r"^\p{Ll}").alias("lower"),
        fn.strip_hyphens(t).alias("bare"), F.contains(F.lower(t), F.lit("bold")).alias("has_bold"), fn.first(t, 20).alias("prefix"),
    )


QUERIES = {
    "para_segment": lambda s, d: _paras(s, d).select("doc_id", "id", "paragraph_number", "chapter", "section", *(F.col(c).cast("long").alias(c) for c in ("page_start", "page_end", "n_blocks")), "text"),
    "blocks_scan": lambda s, d: _longs(_blocks(s, d), "page"),
    "body_font_size": lambda s, d: statistics.body_font_size(_blocks(s, d)),
    "page_counts": lambda s, d: statistics.page_counts(_blocks(s, d)),
    "repeated_furniture": lambda s, d: statistics.repeated_furniture(_blocks(s, d)),
    "furniture_semi": lambda s, d: classify.keep_furniture(_blocks(s, d), statistics.repeated_furniture(_blocks(s, d))).select("doc_id", "idx", "text"),
    "furniture_anti": lambda s, d: classify.drop_furniture(_blocks(s, d), statistics.repeated_furniture(_blocks(s, d))).select("doc_id", "idx", "text"),
    "edge_furniture": lambda s, d: _blocks(s, d).where(classify.at_edge()).select("doc_id", "idx", "text"),
    "footnotes": lambda s, d: _blocks(s, d).join(statistics.body_font_size(_blocks(s, d)), "doc_id").where(classify.is_footnote()).select("doc_id", "idx", "font_size", "text"),
    "headings": lambda s, d: _blocks(s, d).join(statistics.body_font_size(_blocks(s, d)), "doc_id").where(classify.is_heading()).select("doc_id", "idx", "text", classify.is_section().alias("is_section")),
    "block_kinds": lambda s, d: _kinds(s, d).select("doc_id", "idx", "kind"),
    "heading_context": lambda s, d: paragraphs.heading_context(_kinds(s, d)).select("doc_id", "idx", "chapter", "section"),
    "section_reset": lambda s, d: paragraphs.heading_context(_kinds(s, d)).where("kind = 'chapter'").select("doc_id", "idx", "chapter", "section"),
    "continues_flag": lambda s, d: _body(s, d).select("doc_id", "idx", "continues"),
    "para_number_extract": lambda s, d: _blocks(s, d).select("doc_id", "idx", fn.para_number(F.col("text")).alias("paragraph_number")),
    "dehyphenate": lambda s, d: _blocks(s, d).select("doc_id", "idx", fn.dehyphenate(F.col("text")).alias("text")),
    "collapse_ws": lambda s, d: fixtures.documents(s, d).select("doc_id", fn.collapse(F.concat(F.lit(" \t"), "text", F.lit("\n  "))).alias("text")),
    "join_lines": _join_lines,
    "para_records": lambda s, d: _longs(plans.records(_paras(s, d)), "page_start", "page_end"),
    "para_envelope_counts": lambda s, d: plans.envelopes(_paras(s, d)).select("source", "paragraph_count", F.size("paragraphs").cast("long").alias("n_records"), F.element_at("paragraphs", -1).id.alias("last_id")),
    "para_numbered_count": lambda s, d: _paras(s, d).groupBy("doc_id").agg(F.count("paragraph_number").alias("numbered")),
    "para_preview_top3": lambda s, d: _longs(plans.preview(_paras(s, d)), "page_start"),
    "para_head20": lambda s, d: _longs(plans.records(_paras(s, d)).orderBy("doc_id", "id").limit(20), "page_start", "page_end"),
    "para_cross_page": lambda s, d: _longs(_paras(s, d).where("page_start < page_end").select("doc_id", "id", "page_start", "page_end"), "page_start", "page_end"),
    "hyphen_merge": lambda s, d: _body(s, d).withColumn("before", F.lag("text").over(paragraphs.order())).where(F.col("continues") & fn.ends_in(F.col("before"), "-")).select("doc_id", "idx", F.concat(fn.strip_hyphens(F.col("before")), "text").alias("text")),
    "line_cluster": lambda s, d: _longs(layout.with_lines(_frags(s, d)).select("doc_id", "page", "seq", "line_no", "pos"), "page", "line_no", "pos"),
    "line_finish": lambda s, d: _longs(_lines(s, d), "page", "line_no"),
    "dominant_size": lambda s, d: _blocks(s, d).groupBy("doc_id").agg(layout.dominant("font_size", "idx").alias("size")),
    "bold_by_chars": lambda s, d: _longs(_lines(s, d).where("bold").select("doc_id", "page", "line_no"), "page", "line_no"),
    "line_gap_median": lambda s, d: _longs(layout.line_gap(_lines(s, d)), "page"),
    "block_group": lambda s, d: _longs(layout.finish_blocks(layout.with_blocks(_lines(s, d))).drop("page_height"), "page", "block_no", "n_lines"),
    "union_pages": lambda s, d: _longs(_blocks(s, d).where("page = 1").unionByName(_blocks(s, d).where("page = 2")).select("doc_id", "page", "idx", "text"), "page"),
    "classify_text_fns": _text_functions,
    "pdf_paragraphs": lambda s, d: sample_pdf.paragraphs(s, d),
}

_FX = r"""fx AS (
  SELECT doc_id // 10 AS doc_id, doc_id % 10 + 1 AS page, ln, line, (doc_id * 7 + ln) % 17 AS m,
    regexp_replace(line, '\.$', '') AS np, trim(translate(substr(line, 1, 30), '.!?:;,', '')) AS hd
  FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS ln FROM (SELECT doc_id, str_split(text, chr(10)) AS a FROM documents))),
dec AS (
  SELECT doc_id, page, ln, CASE m WHEN 0 THEN (ln + 1)::varchar || ' ' || hd WHEN 1 THEN '2.' || (ln + 1)::varchar || ' ' || hd WHEN 3 THEN page::varchar
      WHEN 4 THEN np || '-' WHEN 5 THEN np WHEN 6 THEN np WHEN 7 THEN (ln + 1)::varchar || '. ' || line WHEN 8 THEN 'and ' || line
      WHEN 9 THEN 'pre- and ' || line WHEN 10 THEN hd WHEN 11 THEN 'Guide header' ELSE line END AS text,
    (CASE WHEN m IN (0, 10) THEN 14 WHEN m = 2 THEN 8 ELSE 10 END)::double AS font_size, m IN (1, 12) AS bold,
    (CASE WHEN m = 3 THEN 820 ELSE 100 + 60 * (ln % 10) END)::double AS y0, 842::double AS page_height FROM fx),
blocks AS (SELECT doc_id, page::bigint AS page, text, font_size, bold, y0, page_height, row_number() OVER (PARTITION BY doc_id ORDER BY page, ln) AS idx FROM dec WHERE text <> '')"""
_STATS = """sized AS (SELECT doc_id, font_size, sum(length(text)) AS chars, min(idx) AS seen FROM blocks GROUP BY ALL),
sizes AS (SELECT doc_id, font_size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, seen) AS k FROM sized) WHERE k = 1),
npages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY 1),
furniture AS (SELECT doc_id, text, on_pages FROM (SELECT doc_id, text, count(DISTINCT page) AS on_pages FROM blocks GROUP BY 1, 2) JOIN npages USING (doc_id) WHERE on_pages >= greatest(3, pages // 4))"""
_EDGE = "(y0 < 0.07::double * page_height OR y0 > 0.93::double * page_height) AND length(text) <= 40 AND right(text, 1) NOT IN ('.', '!', '?', ':', ';', '”', '’', ')')"
_HEAD = r"(NOT (length(text) > 150 OR right(text, 1) IN ('.', '!', '?')) AND (font_size >= body_size + 1 OR (bold AND regexp_matches(text, '^\d+(\.\d+)*\s+\S'))))"
_SECT = r"regexp_matches(text, '^\d+(\.\d+)+\s+\S')"
_KINDS = f"""kinds AS (SELECT b.*, CASE WHEN f.text IS NOT NULL THEN 'furniture' WHEN {_EDGE.replace('text', 'b.text')} THEN 'edge' WHEN font_size <= body_size - 1.5 THEN 'footnote'
    WHEN {_HEAD.replace('text', 'b.text')} THEN CASE WHEN {_SECT.replace('text', 'b.text')} THEN 'section' ELSE 'chapter' END ELSE 'body' END AS kind
  FROM blocks b JOIN sizes USING (doc_id) LEFT JOIN furniture f ON f.doc_id = b.doc_id AND f.text = b.text)"""
_CONTEXT = """ctx0 AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN text END IGNORE NULLS) OVER w AS chapter,
    max(CASE WHEN kind = 'chapter' THEN idx END) OVER w AS ch_at, max(CASE WHEN kind = 'section' THEN idx END) OVER w AS se_at,
    last_value(CASE WHEN kind = 'section' THEN text END IGNORE NULLS) OVER w AS se FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ctx AS (SELECT *, CASE WHEN se_at > coalesce(ch_at, 0) THEN se END AS section FROM ctx0)"""
_PARAS = r"""body0 AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM ctx WHERE kind = 'body'),
body AS (SELECT *, before IS NOT NULL AND NOT regexp_matches(text, '^\d{1,3}\.\s+[A-Z“‘(]') AND (right(before, 1) = '-' OR regexp_matches(text, '^\p{Ll}')
    OR substr(text, 1, 1) IN (',', ';', ':', ')', '–', '—', '-', '”', '’') OR right(rtrim(before), 1) NOT IN ('.', '!', '?', ':', ';', '”', '’', ')')) AS continues FROM body0),
num AS (SELECT *, sum((NOT continues)::int) OVER (PARTITION BY doc_id ORDER BY idx) AS id, coalesce(lead(continues) OVER (PARTITION BY doc_id ORDER BY idx), false) AS goes_on FROM body),
paras AS (SELECT doc_id, id::bigint AS id, arg_min_null(nullif(regexp_extract(text, '^(\d{1,3})\.\s+[A-Z“‘(]', 1), ''), idx) AS paragraph_number,
    arg_min_null(chapter, idx) AS chapter, arg_min_null(section, idx) AS section, arg_min(page, idx) AS page_start, arg_max(page, idx) AS page_end, count(*) AS n_blocks,
    string_agg(CASE WHEN NOT goes_on THEN text WHEN right(text, 1) = '-' THEN rtrim(text, '-') ELSE text || ' ' END, '' ORDER BY idx) AS text FROM num GROUP BY 1, 2)"""
_FRAGS = """w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS a FROM documents)),
frags AS (SELECT doc_id // 10 AS doc_id, doc_id % 10 + 1 AS page, pos + 1 AS seq, (50 + 7 * (pos % 8))::double AS x,
    60 + 14 * (pos // 8) + (CASE WHEN (pos // 8) % 6 = 5 THEN 12 ELSE 0 END) + 0.25::double * (pos % 3) AS y_top,
    (CASE WHEN (pos // 8) % 9 = 4 THEN 14 ELSE 10 END)::double AS size, (doc_id + pos) % 5 < 2 AS bold, word || ' ' AS text FROM w),
fo AS (SELECT *, round_even(y_top, 1) AS y_r FROM frags),
fg AS (SELECT *, y_top - lag(y_top) OVER (PARTITION BY doc_id, page ORDER BY y_r, x, seq) AS gap FROM fo),
fl AS (SELECT *, 1 + sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y_r, x, seq) AS line_no FROM fg),
fp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY x, y_r, seq) AS pos FROM fl)"""
_LINES = r"""sz AS (SELECT doc_id, page, line_no, size, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY count(*) DESC, min(pos)) AS k FROM fp WHERE trim(text) <> '' GROUP BY 1, 2, 3, 4),
lines AS (SELECT doc_id, page::bigint AS page, line_no::bigint AS line_no, trim(regexp_replace(string_agg(text, '' ORDER BY pos), '\s+', ' ', 'g')) AS text, min(x) AS x, min(y_top) AS y_top,
    coalesce(any_value(s.size), 0) AS size, coalesce(sum(length(text)) FILTER (bold), 0) > greatest(sum(length(text)), 1) / 2 AS bold
  FROM fp LEFT JOIN (SELECT doc_id, page, line_no, size FROM sz WHERE k = 1) s USING (doc_id, page, line_no) GROUP BY 1, 2, 3)"""
_GAPS = """lg AS (SELECT *, y_top - lag(y_top) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS gap, abs(size - lag(size) OVER (PARTITION BY doc_id, page ORDER BY line_no)) AS step FROM lines{}),
med AS (SELECT doc_id, page, coalesce(g[len(g) // 2 + 1], 12) AS median_gap FROM (SELECT doc_id, page, list_sort(coalesce(list(gap) FILTER (gap > 0 AND gap < 40), [])) AS g FROM lg GROUP BY 1, 2))"""
_GROUPS = r"""bl AS (SELECT *, 1 + sum((coalesce(gap > median_gap * 1.6::double OR gap < 0 OR step > 0.6, false))::int) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS block_no FROM lg JOIN med USING (doc_id, page)),
bs AS (SELECT doc_id, page, block_no, size, row_number() OVER (PARTITION BY doc_id, page, block_no ORDER BY count(*) DESC, min(line_no)) AS k FROM bl GROUP BY 1, 2, 3, 4)"""

_FOUND = r"""SELECT doc_id, page, block_no::bigint AS block_no, trim(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY line_no), '([\p{L}\p{N}_])-\s+([a-zà-ÿ])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text,
  any_value(s.size) AS font_size, sum(bold::int) > count(*) / 2 AS bold, min(y_top) AS y0, count(*) AS n_lines FROM bl JOIN (SELECT doc_id, page, block_no, size FROM bs WHERE k = 1) s USING (doc_id, page, block_no) GROUP BY 1, 2, 3"""
# What the sample files hold: the lines of `sample_pdf.document_pdf`, 40 a page, 16 points apart, the first 82 points from the top.
_PRINTED = r"""raw AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS k FROM (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
cut AS (SELECT doc_id, k, 0 AS part, (k // 7 + 1)::varchar || ' ' || rtrim(x, '.!?') AS text, 14::double AS size, true AS bold FROM raw WHERE k % 7 = 0 AND length(x) <= 80
  UNION ALL SELECT doc_id, k, part, substr(x, 80 * part + 1, 80), 10, false FROM (SELECT *, unnest(range((length(x) + 79) // 80)) AS part FROM raw WHERE k % 7 > 0 OR length(x) > 80)),
printed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1 AS n FROM cut),
lines AS (SELECT 'doc-' || doc_id || '.pdf' AS doc_id, n // 40 + 1 AS page, n % 40 + 1 AS line_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, 72::double AS x, (82 + 16 * (n % 40))::double AS y_top, size, bold FROM printed)"""
_PRINTED_BLOCKS = f"""grouped AS ({_FOUND}),
blocks AS (SELECT * EXCLUDE (block_no, n_lines), 842::double AS page_height, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_no) AS idx FROM grouped WHERE text <> '')"""


def _sql(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


_TO_KINDS = (_FX, _STATS, _KINDS)
_TO_CONTEXT = (*_TO_KINDS, _CONTEXT)
_TO_PARAS = (*_TO_CONTEXT, _PARAS)
_RECORD = "doc_id, id, paragraph_number, chapter, section, page_start, page_end, text"

ORACLES = {
    "para_segment": _sql(f"SELECT {_RECORD}, n_blocks FROM paras", *_TO_PARAS),
    "blocks_scan": _sql("SELECT * FROM blocks", _FX),
    "body_font_size": _sql("SELECT * FROM sizes", _FX, _STATS),
    "page_counts": _sql("SELECT * FROM npages", _FX, _STATS),
    "repeated_furniture": _sql("SELECT * FROM furniture", _FX, _STATS),
    "furniture_semi": _sql("SELECT doc_id, idx, text FROM blocks SEMI JOIN furniture USING (doc_id, text)", _FX, _STATS),
    "furniture_anti": _sql("SELECT doc_id, idx, text FROM blocks ANTI JOIN furniture USING (doc_id, text)", _FX, _STATS),
    "edge_furniture": _sql(f"SELECT doc_id, idx, text FROM blocks WHERE {_EDGE}", _FX),
    "footnotes": _sql("SELECT doc_id, idx, font_size, text FROM blocks JOIN sizes USING (doc_id) WHERE font_size <= body_size - 1.5", _FX, _STATS),
    "headings": _sql(f"SELECT doc_id, idx, text, {_SECT} AS is_section FROM blocks JOIN sizes USING (doc_id) WHERE {_HEAD}", _FX, _STATS),
    "block_kinds": _sql("SELECT doc_id, idx, kind FROM kinds", *_TO_KINDS),
    "heading_context": _sql("SELECT doc_id, idx, chapter, section FROM ctx", *_TO_CONTEXT),
    "section_reset": _sql("SELECT doc_id, idx, chapter, section FROM ctx WHERE kind = 'chapter'", *_TO_CONTEXT),
    "continues_flag": _sql("SELECT doc_id, idx, continues FROM body", *_TO_PARAS),
    "para_number_extract": _sql(r"SELECT doc_id, idx, nullif(regexp_extract(text, '^(\d{1,3})\.\s+[A-Z“‘(]', 1), '') AS paragraph_number FROM blocks", _FX),
    "dehyphenate": _sql(r"SELECT doc_id, idx, regexp_replace(text, '([\p{L}\p{N}_])-\s+([a-zà-ÿ])', '\1\2', 'g') AS text FROM blocks", _FX),
    "collapse_ws": r"SELECT doc_id, trim(regexp_replace(' ' || text || ' ', '\s+', ' ', 'g')) AS text FROM documents",
    "join_lines": r"""WITH l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS k, len(a) AS n FROM (SELECT doc_id, str_split(text, chr(10)) AS a FROM documents)),
d AS (SELECT doc_id, k, n, trim(regexp_replace(CASE k % 3 WHEN 1 THEN 'and  ' || x WHEN 2 THEN ' ' || x ELSE regexp_replace(x, '\.$', '') || '-' END, '\s+', ' ', 'g')) AS x FROM l),
p AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM d)
SELECT doc_id, string_agg(CASE WHEN after IS NULL THEN x WHEN right(x, 1) = '-' AND regexp_matches(after, '^\p{Ll}') THEN left(x, length(x) - 1) ELSE x || ' ' END, '' ORDER BY k) AS joined FROM p GROUP BY 1""",
    "para_records": _sql(f"SELECT {_RECORD} FROM paras", *_TO_PARAS),
    "para_envelope_counts": _sql("SELECT doc_id AS source, count(*) AS paragraph_count, count(*) AS n_records, max(id) AS last_id FROM paras GROUP BY 1", *_TO_PARAS),
    "para_numbered_count": _sql("SELECT doc_id, count(paragraph_number) AS numbered FROM paras GROUP BY 1", *_TO_PARAS),
    "para_preview_top3": _sql("SELECT paragraph_number, chapter, section, page_start, substr(text, 1, 300) AS text FROM paras WHERE paragraph_number IS NOT NULL ORDER BY doc_id, id LIMIT 3", *_TO_PARAS),
    "para_head20": _sql(f"SELECT {_RECORD} FROM paras ORDER BY doc_id, id LIMIT 20", *_TO_PARAS),
    "para_cross_page": _sql("SELECT doc_id, id, page_start, page_end FROM paras WHERE page_start < page_end", *_TO_PARAS),
    "hyphen_merge": _sql("SELECT doc_id, idx, rtrim(before, '-') || text AS text FROM body WHERE continues AND right(before, 1) = '-'", *_TO_PARAS),
    "line_cluster": _sql("SELECT doc_id, page, seq, line_no::bigint AS line_no, pos FROM fp", _FRAGS),
    "line_finish": _sql("SELECT * FROM lines", _FRAGS, _LINES),
    "dominant_size": _sql("SELECT doc_id, font_size AS size FROM (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(idx)) AS k FROM blocks GROUP BY 1, 2) WHERE k = 1", _FX),
    "bold_by_chars": _sql("SELECT doc_id, page, line_no FROM lines WHERE bold", _FRAGS, _LINES),
    "line_gap_median": _sql("SELECT * FROM med", _FRAGS, _LINES, _GAPS.format("")),
    "block_group": _sql(_FOUND, _FRAGS, _LINES, _GAPS.format(" WHERE text <> ''"), _GROUPS),
    "union_pages": _sql("SELECT doc_id, page, idx, text FROM blocks WHERE page = 1 UNION ALL SELECT doc_id, page, idx, text FROM blocks WHERE page = 2", _FX),
    "classify_text_fns": _sql(r"""SELECT doc_id, idx, length(text) AS n, substr(text, 1, 1) AS head, right(text, 1) IN ('.', '!', '?', ':', ';', '”', '’', ')') AS ends, regexp_matches(text, '^\p{Ll}') AS lower,
  rtrim(text, '-') AS bare, contains(lower(text), 'bold') AS has_bold, substr(text, 1, 20) AS prefix FROM blocks""", _FX),
    "pdf_paragraphs": _sql(
        "SELECT doc_id, id, paragraph_number, chapter, section, page_start::int AS page_start, page_end::int AS page_end, text, length(text)::int AS n FROM paras",
        _PRINTED, _GAPS.format(" WHERE text <> ''"), _GROUPS, _PRINTED_BLOCKS, _STATS, _KINDS, _CONTEXT, _PARAS,
    ),
}
