"""A corpus from raw documents: quality rules, toxicity, near-duplicates, decontamination, tokens."""

from __future__ import annotations

import public_tokenizers

from porelight.llm import bpe, decontaminate, quality, simhash_similar, toxicity
from porelight.llm.common import give_back, read_table, stored


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the likelihood ratio reject go."""
    give_back(spark)
    return quality.keep_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def no_toxicity(spark, docs, sf_dir):
    """Documents with a score of 0.5 or more go."""
    give_back(spark)
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    """The document of the least id of each group of near-duplicates (five-word similarity of 0.8 or more) stays."""
    return simhash_similar.drop_similar(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    give_back(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Every document that is left, encoded and decoded."""
    give_back(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", no_toxicity),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the fitted models and the byte-pair encoding.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to ``documents``; what each keeps is written before the next reads it, for most read it more than once."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
