"""Registered queries of this package: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from caseflow.llm import (bpe, chat_format, exact_dedup, language_id, ngram_join, packing, pii, quality_rules,
                          runs, source_divergence, suffix_dedup, url_filter, vector_tree)
from caseflow.llm.common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pii(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"),
                                              public_tokenizers.path("word_bpe_49k.json")))


def op9_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_chat_format(spark, sf_dir):
    return chat_format.conversations(table(spark, sf_dir, "conversations"))


def op11_source_divergence(spark, sf_dir):
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op13_nearest_vectors(spark, sf_dir):
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_quality_rules, op4_exact_dedup, op5_ngram_join,
                                   op6_byte_bpe, op7_pii, op8_packing, op9_url_filter, op10_chat_format,
                                   op11_source_divergence, op12_periodic_runs, op13_nearest_vectors)}
ORACLES = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE,
           "op4_exact_dedup": exact_dedup.ORACLE, "op5_ngram_join": ngram_join.ORACLE,
           "op11_source_divergence": source_divergence.ORACLE, "op12_periodic_runs": runs.ORACLE}
