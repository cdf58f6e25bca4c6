"""Queries of the operators for language-model data, and their SQL."""

from __future__ import annotations

from graphloom.llm import packing, reading, tokenizer, validity
from graphloom.session import table


def p4_found(spark, d):
    return validity.invalid_files(table(spark, d, "file_texts")).select("path")


def p4_files(spark, d):
    return validity.invalid_files(table(spark, d, "file_texts"))


def p4_rates(spark, d):
    return validity.rates(table(spark, d, "file_texts"))


def p4_causes(spark, d):
    return validity.causes(table(spark, d, "file_texts"))


def p7_ids(spark, d):
    return tokenizer.encode(table(spark, d, "documents"), keep=["doc_id"])


def p7_decoded(spark, d):
    """Texts from their ids."""
    return tokenizer.decode(p7_ids(spark, d))


def p8_packed(spark, d):
    return packing.pack(packing.token_pieces(table(spark, d, "documents")))


def p8_utilisation(spark, d):
    return packing.utilisation(p8_packed(spark, d))


def _levels(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark, d):
    return _levels(spark, d).filter("demanding").select("doc_id")


def p9_levels(spark, d):
    return _levels(spark, d)


def p9_formula(spark, d):
    """The plain two-figure formula, which needs no judgements."""
    return reading.reading_levels(table(spark, d, "documents")).select("doc_id", "lang", "unfamiliar", "sentence_length", "formula", "demanding")


def p9_profile(spark, d):
    return reading.profile(_levels(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_files, p4_rates, p4_causes, p7_ids, p7_decoded, p8_packed, p8_utilisation, p9_found, p9_levels, p9_formula, p9_profile)}

SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
