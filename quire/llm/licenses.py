"""License scan: sparse TF-IDF cosine of header lines and whole files to templates, then inheritance
from the nearest ancestor directory that holds a licence file.

A document's lines are the units whose frequencies give the weights: idf(t) = ln((N + 1) / (df + 1)) + 1
over all lines of all files. Vectors live on the templates' terms; any other token weighs as a term that no
line has. By the inequality of Cauchy and Schwarz, a unit whose cosine to a template reaches the
threshold holds one of the template's essential terms: those left after dropping the lightest ones
while their squares sum to less than the squared threshold of the whole. Only files with an essential term are looked at
closely; no match is lost.

All of it is DataFrame operations. The templates are few and fixed, so their weights are literals.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import words

LINE_COSINE, FILE_COSINE = 0.6, 0.5
#: Notices by which the licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
LICENSE_NAME = r"(?i)^(licen[cs]e|copying)(\..*)?$"


def _tokens(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


class Weights:
    """idf of the templates' terms, unit vectors of the templates and their essential terms."""

    def __init__(self, lines: int, df: dict[str, int]):
        self.counts = [(name, _tokens(text)) for name, text in TEMPLATES]
        idf = lambda n: math.log((lines + 1) / (n + 1)) + 1
        self.unseen = idf(0)
        self.idf = {t: idf(df.get(t, 0)) for t in vocabulary()}
        self.vectors = []
        for name, c in self.counts:
            v = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {t: x / norm for t, x in v.items()}))

    def essential(self, cosine: float) -> list[str]:
        found = set()
        for _, v in self.vectors:
            light = 0.0
            for t, x in sorted(v.items(), key=lambda i: (i[1], i[0])):
                light += x * x
                if light >= cosine * cosine * (1 - 1e-5):  # scores are rounded to six digits before they meet the threshold
                    found.add(t)
        return sorted(found)


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in _tokens(text)})


def _literal(terms: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms))


def line_weights(files: DataFrame) -> Weights:
    """Counts, over all lines of all files, the lines that hold each term of the templates."""
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).select(words(F.col("line")).alias("tokens"))
    held = lines.select(F.explode(F.concat(F.array_intersect("tokens", _literal(vocabulary())), F.array(F.lit("")))).alias("term"))  # the empty term counts lines
    df = {r.term: r.n for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a template term
    return Weights(df.pop("", 0), df)


def _cosines(units: DataFrame, w: Weights, keys: list[str]) -> DataFrame:
    """keys, license, score: the best template of every unit (column `tokens`) that shares a term with one."""
    spark = units.sparkSession
    idf = spark.createDataFrame([(t, x) for t, x in w.idf.items()], "term string, idf double")
    template = spark.createDataFrame([(k, name, t, x) for k, (name, v) in enumerate(w.vectors) for t, x in v.items()], "k int, license string, term string, w double")
    tf = units.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(w.unseen)))
    # A token outside the templates is a dimension of its own, however often it occurs.
    squares = F.when(F.col("idf").isNull(), F.col("tf") * F.lit(w.unseen * w.unseen)).otherwise(F.col("x") * F.col("x"))
    norm = tf.groupBy(*keys).agg(F.sqrt(F.sum(squares)).alias("norm"))
    dot = tf.where("idf is not null").join(F.broadcast(template), "term").groupBy(*keys, "k", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dot.join(norm, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = F.max_by("license", F.struct("score", -F.col("k"))).alias("license")
    return scored.groupBy(*keys).agg(best, F.max("score").alias("score"))


def declared(files: DataFrame, w: Weights) -> DataFrame:
    """path, license, score, whole: what a file's best line (whole false) and its whole text (true) declare."""
    terms = sorted(set(w.essential(LINE_COSINE)) | set(w.essential(FILE_COSINE)))
    close = files.where(F.arrays_overlap(words(F.col("text")), _literal(terms))).withColumn("row", F.monotonically_increasing_id())
    close = written(close, "license-files")  # from here on row is fixed
    lines = close.select("row", "path", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("row", "path", "n", words(F.col("line")).alias("tokens")).where(F.arrays_overlap("tokens", _literal(w.essential(LINE_COSINE))))
    by_line = _cosines(lines, w, ["row", "path", "n"]).where(F.col("score") >= LINE_COSINE)
    by_file = _cosines(close.select("row", "path", words(F.col("text")).alias("tokens")), w, ["row", "path"]).where(F.col("score") >= FILE_COSINE)
    best = lambda df: df.groupBy("row", "path").agg(F.max(F.struct("score", "license")).alias("b")).select("row", "path", "b.license", "b.score")
    return written(best(by_line).withColumn("whole", F.lit(False)).union(best(by_file).withColumn("whole", F.lit(True))), "license-declared")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame, licence_files: DataFrame) -> DataFrame:
    """dir, license: for every directory of a file, the licence of the nearest directory above it, or itself, that holds a licence file (path, license, score)."""
    held = licence_files.groupBy(_directory(F.col("path")).alias("at")).agg(F.max(F.struct("score", "license")).alias("b")).select("at", F.col("b.license").alias("license"))
    dirs = files.select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))).alias("a")).select("dir", "a.depth", "a.at")
    return written(above.distinct().join(held, "at").groupBy("dir").agg(F.max_by("license", "depth").alias("license")), "license-directories")


def scan(files: DataFrame) -> DataFrame:
    """id, path, license, found (header, file, inherited or null) and score of every file; files has id, path, text.

    A licence file is one whose whole text is a licence or whose name says so and whose text declares one. Its own declaration
    comes before an inherited one. Null texts declare nothing, null paths count as a file at the top;
    files with the same path share the best declaration of that path; repeated rows each give a row;
    an empty table gives none. Other columns are ignored.
    """
    files = files.select("id", F.coalesce("path", F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    found = declared(files, line_weights(files))
    own = written(found.groupBy("path").agg(F.max(F.struct((~F.col("whole")).alias("header"), "score", "license")).alias("b")).select("path", "b.license", "b.score", F.when(F.col("b.header"), "header").otherwise("file").alias("found")), "license-own")
    named = F.regexp_replace("path", "^.*/", "").rlike(LICENSE_NAME)
    licence_files = found.where(F.col("whole") | named).select("path", "license", "score")
    above = inherited(files, licence_files).withColumnRenamed("license", "from_above")
    out = files.select("id", "path", _directory(F.col("path")).alias("dir")).join(own, "path", "left").join(above, "dir", "left")
    return out.select("id", "path", F.coalesce("license", "from_above").alias("license"), F.when(F.col("license").isNotNull(), F.col("found")).when(F.col("from_above").isNotNull(), "inherited").alias("found"), "score")


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files: source, language and thousand are their directories."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")


def oracle() -> str:
    """The scan of `documents` in SQL, without the filter by essential terms."""
    texts = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    words_of = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    cosine = lambda units, keys: f"""(SELECT {keys}, k, license, round(sum(CASE WHEN t.term IS NOT NULL THEN tf * idf * w END) / any_value(norm), 6) AS score
    FROM (SELECT *, sqrt(sum(sq) OVER (PARTITION BY {keys})) AS norm FROM (SELECT {keys}, f.term, tf, coalesce(i.idf, un) AS idf, CASE WHEN i.idf IS NULL THEN tf * un * un ELSE (tf * i.idf) * (tf * i.idf) END AS sq
      FROM (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(ws) AS term FROM {units}) GROUP BY ALL) f LEFT JOIN idf i USING (term), (SELECT ln(lines + 1) + 1 AS un FROM n))) JOIN vec t USING (term) GROUP BY {keys}, k, license)"""  # noqa: E731
    best = lambda units, keys, least: f"(SELECT doc_id, max(score) AS score, max(struct_pack(s := score, l := license)).l AS license FROM (SELECT {keys}, max(score) AS score, arg_max(license, struct_pack(s := score, k := -k)) AS license FROM {cosine(units, keys)} GROUP BY {keys}) WHERE score >= {least} GROUP BY doc_id)"
    return f"""WITH tpl AS (SELECT * FROM (VALUES {texts}) v(k, license, text)),
ttf AS (SELECT k, license, term, count(*) AS n FROM (SELECT k, license, unnest({words_of("text")}) AS term FROM tpl) GROUP BY ALL),
files AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 1000)::varchar || '/' || doc_id::varchar || '.txt' AS path, text FROM documents),
lines AS (SELECT doc_id, k AS line, {words_of("x")} AS ws FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, str_split(text, chr(10)) AS a FROM files))),
n AS (SELECT count(*) AS lines FROM lines),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS term FROM lines) WHERE term IN (SELECT term FROM ttf) GROUP BY 1),
idf AS (SELECT term, ln((lines + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM ttf) LEFT JOIN df USING (term), n),
vec AS (SELECT k, license, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY k)) AS w FROM ttf JOIN idf USING (term)),
whole AS (SELECT doc_id, {words_of("text")} AS ws FROM files),
header AS {best("lines", "doc_id, line", LINE_COSINE)},
file AS {best("whole", "doc_id", FILE_COSINE)},
dirs AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
held AS (SELECT dir AS held_at, max(struct_pack(s := score, l := license)).l AS license FROM file JOIN dirs USING (doc_id) GROUP BY 1),
above AS (SELECT dir, arg_max(license, length(held_at)) AS license FROM (SELECT DISTINCT dir FROM dirs) d JOIN held h ON h.held_at = '' OR d.dir = h.held_at OR starts_with(d.dir, h.held_at || '/') GROUP BY 1)
SELECT d.doc_id AS id, path, coalesce(h.license, f.license, a.license) AS license, CASE WHEN h.license IS NOT NULL THEN 'header' WHEN f.license IS NOT NULL THEN 'file' WHEN a.license IS NOT NULL THEN 'inherited' END AS found, coalesce(h.score, f.score) AS score
FROM dirs d LEFT JOIN header h USING (doc_id) LEFT JOIN file f USING (doc_id) LEFT JOIN above a USING (dir)"""
