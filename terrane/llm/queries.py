"""The registered queries of the corpus operators, at production parameters over whole tables."""

from __future__ import annotations

from terrane.llm import license_scan as licenses
from terrane.llm.common import table
from terrane.llm.fingerprints import document_fingerprints
from terrane.llm.language_id import language_id
from terrane.llm.line_dedup import line_dedup
from terrane.llm.mixing import curriculum_mix
from terrane.llm.ngram_join import ngram_join
from terrane.llm.ordinal_quality import ordinal_quality
from terrane.llm.packing import pack
from terrane.llm.quality_rules import quality_rules
from terrane.llm.url_filter import url_filter


def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_classifier(spark, sf_dir):
    return ordinal_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def op7_mixing(spark, sf_dir):
    return curriculum_mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark, sf_dir):
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES = (op1_quality_rules, op2_ngram_join, op3_line_dedup, op4_packing, op5_quality_classifier, op6_url_filter, op7_mixing, op8_language_id, op9_fingerprints, op10_license_scan)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op10_license_scan": licenses.oracle()}
