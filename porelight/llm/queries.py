"""The queries that apply the operators of this subpackage to their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from porelight.llm import bpe, chat, decontaminate, html_crf, licenses, quality, sharding, simhash, token_files, toxicity
from porelight.llm.common import read_table as read


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return html_crf.extract(read(spark, sf_dir, "pages"), carry=("url",)).select("page_id", "url", "text", "n_chars")


def op3_chat_formatting(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = "conv_id long, messages array<struct<role string, content string>>"
    more = spark.createDataFrame([(-1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])], kind)
    turns = chat.canonical_turns(said, "conv_id").unionByName(chat.canonical_turns(more, "conv_id"))
    return chat.digests(chat.read_turns(chat.format_turns(turns)), "conv_id")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_token_ids(spark, sf_dir):
    import public_tokenizers

    return token_files.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql():
    return {
        "op3_chat_formatting": chat.oracle(),
        "op4_license_scan": licenses.oracle(),
        "op8_decontamination": decontaminate.oracle(),
    }
