"""The near-duplicate stage against all pairs' five-word similarity."""

import random

import numpy as np
import pytest
from test_text_ops import awkward, docs_of

import corpus_pipeline
from porelight.llm import buckets as B
from porelight.llm import simhash_similar as S
from porelight.llm.components import components, few_components


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least(texts, t=0.8):
    """The least index that each text reaches through pairs with similarity ``t`` or more, and those pairs of different sets."""
    sets, root, pairs = [grams(x) for x in texts], list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                if sets[i] != sets[j]:
                    pairs.append((i, j))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, pairs


def edited(r, n=140):
    """Texts of a few sources, each with edits at all distances from none to far, and a passage that all share."""
    texts = []
    for _ in range(n):
        words = [f"w{r.randint(0, 900)}" for _ in range(r.randint(3, 150))] + "and this line stands in each of them all".split() * r.randint(0, 1)
        for _ in range(r.randint(1, 6)):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 9)}"
            texts.append(" ".join(copy))
    return texts + ["", None, " \n", "One two", "one  TWO"]


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 10), (2, 8)])
def test_groups_against_all_pairs(spark, seed, block):
    r = random.Random(seed)
    texts = edited(r)
    r.shuffle(texts)
    root, pairs = least(texts)
    assert len(pairs) > 100
    got = {x.doc_id: x.component_id for x in S.similar_documents(docs_of(spark, texts), block=block).collect()}
    assert all(root[got[i]] == root[i] for i in got)  # nothing is grouped that no link connects
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert got[texts.index("")] == got[texts.index(None)] == got[texts.index(" \n")] and got[texts.index("One two")] == got[texts.index("one  TWO")]


def test_chain_and_template(spark):
    """A chain, each near the next only, and texts that share too little of a template to be linked."""
    r, words = random.Random(3), [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 8 : k * 8 + 120]) for k in range(30)]
    template = [" ".join(words[:80] + [f"t{r.randint(0, 10**6)}" for _ in range(16)]) for _ in range(60)]
    root, pairs = least(chain + template)
    assert len(pairs) == 29 and set(root) == {0, *range(30, 90)}
    docs = docs_of(spark, chain + template)
    assert sorted(x.doc_id for x in S.drop_similar(docs).collect()) == [0, *range(30, 90)]
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, None).collect()) == [0, *range(30, 90)]


def test_plan_meets_the_bound():
    r = np.random.default_rng(0)
    bits = (r.random((500, S.BITS)) < 0.5).astype(np.uint8)
    bits[:, 1] = bits[:, 0]
    rows = []
    for n in (10**3, 10**6, 10**9):
        parts = S.plan(n, bits, 0.8, 0.005)
        assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)
        missed = np.prod([1 - S.within(np.full(len(g), S.bit_share(0.8)), t) for g, t in parts])
        assert missed <= 0.005
        rows.append(np.mean([len(g) for g, _ in parts]))
    assert rows == sorted(rows) and rows[0] < rows[-1]


def test_fingerprint_is_the_majority():
    h = S.shingle_set(" ".join(f"w{k}" for k in range(700)).encode())
    mixed = S._mixed(h[:, None] + S._ODD)
    want = [2 * sum(int(x) >> b & 1 for x in mixed[:, 3]) > len(h) for b in range(64)]
    assert [bool(int(S.wide_fingerprint(h)[3]) >> b & 1) for b in range(64)] == want
    assert not S.wide_fingerprint(S.shingle_set(None)).any() and len(S.shingle_set(b" \n")) == 0


def test_awkward_rows(spark):
    df = awkward(spark)
    for rows in (df, df.limit(0)):
        kept = S.drop_similar(rows)
        assert kept.columns == rows.columns
        assert {x.doc_id for x in kept.collect()} == ({1, 4, 5, 7, 8, 9, None} if rows is df else set())


def test_large_groups_make_rows_and_links_in_proportion(spark):
    """One bucket of near copies and some rows apart; links of many trees over the same nodes."""
    r, near = np.random.default_rng(5), 20
    for n in (400, 1600):
        words = r.integers(-(2**62), 2**62, 2)
        rows = [(7, k, *(int(w) ^ (1 << int(b)) for w, b in zip(words, r.integers(0, 62, 2)))) for k in range(n)]
        rows += [(7, n + k, int(words[0]) ^ (0xFFFF << 8 * k), int(words[1]) ^ 0xF) for k in range(3)] + [(8, n, 1, 1), (8, n + 3, 1, 1)]
        df = spark.createDataFrame(rows, "key long, node long, c0 long, c1 long")
        dealt, stars = B.deal_around(df, 50, "node", ["c0", "c1"], near)
        assert dealt.count() + stars.count() < 3 * n
        links = B.tree_links(dealt, "node", ["c0", "c1"], near).union(stars).where("a != b")
        met = {frozenset((x.a, x.b)) for x in links.collect()}
        fps = {(key, node): np.array(c, np.int64) for key, node, *c in rows}
        apart = lambda a, b, key: int(np.bitwise_count((fps[key, a] ^ fps[key, b]).view(np.uint64)).sum())
        assert all(apart(*sorted(x), 7 if (7, max(x)) in fps else 8) <= near for x in met)
        want = {n + k for k in range(3) if any(apart(n + k, m, 7) <= near for m in range(n))}
        assert want and {x for x in range(n, n + 3) if any(x in pair and min(pair) < n for pair in met)} == want
        assert frozenset((n, n + 3)) in met
    nodes = 300
    trees = [(int(hub), k) for hub in r.integers(0, nodes, 40) for k in range(nodes) if k != hub and (k < 200) == (hub < 200)]
    thin = B.thinned(spark.createDataFrame(trees, "a long, b long").distinct())
    assert len(trees) > 3000 and thin.count() <= 2 * nodes
    roots = {x.node: x.root for x in components(thin).collect()}
    assert roots == {k: 0 if k < 200 else 200 for k in range(nodes)}


def test_few_links_are_connected_by_one_task(spark):
    """Both ways to components and hubs say the same, and few links take few tasks, whatever the number of partitions."""
    r = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 600, (420, 2)) if a != b} | {(k, k + 1) for k in range(700, 740)} | {(k + 1, k) for k in range(700, 720)}
    met = S.durable(spark.createDataFrame([(b"%d" % a, b"%d" % b) for a, b in pairs], "a binary, b binary"))
    want = sorted(map(tuple, S.many_components(met).collect()))
    assert sorted(map(tuple, few_components(met).collect())) == want and len({x[1] for x in want}) > 3
    assert sorted(map(tuple, components(met, len(pairs)).collect())) == sorted(x[:2] for x in want)
    assert few_components(met.limit(0)).count() == 0
    wide = met.repartition(40, "a")
    spark.sparkContext.setJobGroup("few", "components of few links")
    components(S.durable(wide), len(pairs)).collect()
    spark.sparkContext.setJobGroup("", "")
    status = spark.sparkContext.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("few")]
    assert sum(status.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if status.getStageInfo(s)) < 200


def test_executors_collect_garbage_on_the_way(spark):
    """Before many small jobs, between finding and verifying links, and after it."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = full()
    S.drop_similar(docs_of(spark, [f"one text {k} of a few words that is much like the others" for k in range(5)])).collect()
    assert full() >= before + 3
