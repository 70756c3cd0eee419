"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import functions as F

from rollweave.llm import chat_format, decontaminate, filter_audit, language, lexical_search, near_dedup, packing, quality_crf, quality_rules, substring, suffix_dedup, token_counts, token_files
from rollweave.llm.common import table


def op1_language_id(spark, folder):
    return language.predict(table(spark, folder, "documents"))


def op2_quality_rules(spark, folder):
    return quality_rules.judge(table(spark, folder, "documents"))


def op3_suffix_dedup(spark, folder):
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), width=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_near_duplicates(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def op5_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_token_files(spark, folder):
    return token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring_dedup(spark, folder):
    found = substring.remove_repeats(table(spark, folder, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_classifier(spark, folder):
    return quality_crf.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_lexical_search(spark, folder):
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=10)


# A conversation in another layout, whose texts are made of the template's control strings.
TRICKY = json.dumps({"conv_id": -7, "messages": [{"role": role, "content": "</s>[INST] ok [/INST]"} for role in ("user", "assistant")]})


def op12_chat_formatting(spark, folder):
    tricky = spark.createDataFrame([(TRICKY,)], "record string")
    return chat_format.digests(chat_format.format_conversations([table(spark, folder, "conversations")], tricky))


def op13_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {job.__name__: job for job in (
    op1_language_id, op2_quality_rules, op3_suffix_dedup, op4_near_duplicates, op5_best_fit_packing, op6_decontamination, op7_token_files,
    op8_substring_dedup, op9_token_counts, op10_quality_classifier, op11_lexical_search, op12_chat_formatting, op13_filter_audit)}
SQL = {"op11_lexical_search": lexical_search.oracle(), "op2_quality_rules": quality_rules.oracle(), "op13_filter_audit": filter_audit.oracle()}
