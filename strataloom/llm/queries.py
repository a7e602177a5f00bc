"""Queries of the problems of language-model training data."""

from __future__ import annotations

from strataloom.llm import functions, mixing, packing, pieces, provenance, validity
from strataloom.runtime import table


def p1_found(spark, d):
    return provenance.not_handwritten(table(spark, d, "files"))


def p1_labels(spark, d):
    return provenance.origin_of_files(table(spark, d, "files"))


def p4_found(spark, d):
    return functions.documented_ords(table(spark, d, "symbols"), table(spark, d, "files"))


def p4_pairs(spark, d):
    return functions.documented_functions(table(spark, d, "symbols"), table(spark, d, "files"))


def p4_units(spark, d):
    return functions.extract_units(table(spark, d, "files"))


def p5_found(spark, d):
    return validity.invalid_files(table(spark, d, "files"))


def p5_files(spark, d):
    return validity.checked_files(table(spark, d, "files"))


def p5_rates(spark, d):
    return validity.validity_rates(table(spark, d, "files"))


def p6_containers(spark, d):
    return packing.containers(table(spark, d, "documents"))


def p6_fills(spark, d):
    return packing.fills(packing.containers(table(spark, d, "documents")))


def p7_found(spark, d):
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_uses(spark, d):
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")).uses


def p7_shares(spark, d):
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p7_tempered(spark, d):
    """Shares of the mix in which no source is short."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), tempered=True).shares


def p8_found(spark, d):
    return pieces.oversized(table(spark, d, "documents"))


def p8_pieces(spark, d):
    return pieces.cut_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_labels, p4_found, p4_pairs, p4_units, p5_found, p5_files, p5_rates, p6_containers, p6_fills, p7_found, p7_uses, p7_shares, p7_tempered, p8_found, p8_pieces)}
SQL: dict[str, str] = {}
