"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import classifier, html_text, language, mixing, near_dups, neighbours, pieces, pii, quality_rules, repeats
from .common import table


def op1_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = pieces.encode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark, sf_dir):
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark, sf_dir):
    return neighbours.neighbour_report(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark, sf_dir):
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))


def op10_near_dups(spark, sf_dir):
    return near_dups.class_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_pii, op4_html_text, op5_quality_rules, op6_nearest_neighbours, op7_quality_classifier, op8_mixing, op9_language, op10_near_dups)}
ORACLES = {"op5_quality_rules": quality_rules.ORACLE, "op8_mixing": mixing.ORACLE}
