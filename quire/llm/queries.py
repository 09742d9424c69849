"""Queries op1 to op10 over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers

from . import decontamination, licenses, media, pieces, pii, sharding, simhash, suffixdedup, tokenfiles, toxicity
from .store import table

#: Public vocabulary files that the contracts name.
PIECES, WORDS = (public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "word_bpe_49k.json"))
TOKENIZERS = os.path.dirname(PIECES)


def op1_toxicity(spark, sf_dir):
    return toxicity.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark, sf_dir):
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op3_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op4_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents")).drop("sanitised")


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_pieces(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), PIECES)


def op8_token_files(spark, sf_dir):
    return tokenfiles.token_file_digest(table(spark, sf_dir, "documents"), WORDS)


def op9_suffix_dedup(spark, sf_dir):
    return suffixdedup.repeat_digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_media_columns": op6_media_columns,
    "op7_pieces": op7_pieces,
    "op8_token_files": op8_token_files,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {"op2_licenses": licenses.oracle(), "op10_decontamination": decontamination.oracle()}
