"""The pipeline against its operators' plain forms, and the queries against their SQL."""

import hashlib
import os

import duckdb
import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from porelight.llm import bpe, decontaminate, quality, toxicity
from porelight.llm.common import read_table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_stages_take_effect(spark):
    docs, labels, items = (read_table(spark, SMALL, t) for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    weights = quality.fit_quality(docs, labels)
    left = {i for i, t in texts.items() if quality.verdict((t or "").encode(), weights.astype("float32"), quality.THRESHOLD)[-1]}
    first = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert {r.doc_id for r in first.collect()} == left
    scorer = toxicity.Scorer(toxicity.fit_toxicity(first, labels))
    left = {i for i in left if scorer.score(texts[i] or "") < 0.5}
    second = corpus_pipeline.no_toxicity(spark, first, SMALL)
    assert {r.doc_id for r in second.collect()} == left

    def grams(text):
        w = (text or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, least = {i: grams(texts[i]) for i in left}, {}
    for i in sorted(left):  # groups by repeated search
        near, todo = {i}, [i]
        while todo:
            a = sets[todo.pop()]
            more = {b for b in left if b not in near and (sets[b] == a or len(a & sets[b]) >= 0.8 * len(a | sets[b]) - 1e-9)}
            near |= more
            todo += more
        least[i] = min(near)
    left = {i for i in left if least[i] == i}
    third = corpus_pipeline.near_dedup(spark, second, SMALL)
    assert {r.doc_id for r in third.collect()} == left

    wanted = [g for r in items.collect() if (g := grams(r.text))]
    left = {i for i in left if not any(len(g & grams(texts[i])) >= 0.8 * len(g) - 1e-9 for g in wanted)}
    fourth = corpus_pipeline.decontamination(spark, third, SMALL)
    assert {r.doc_id for r in fourth.collect()} == left and fourth.columns == docs.columns

    library = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).bpe
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == left
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
@pytest.mark.parametrize("name", ["op3_chat_formatting", "op4_license_scan", "op8_decontamination"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.quality_rules, corpus_pipeline.no_toxicity, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.tokens]
    assert decontaminate and set(__spark_entry__.oracle_sql()) <= names
