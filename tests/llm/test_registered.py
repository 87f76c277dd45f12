"""Registered queries without SQL against plain Python, on small tables and on held-out labels."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from porelight.llm import quality, queries
from porelight.llm.common import read_table

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def tables(spark, path, texts, labels=()):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def some_texts(r):
    good = "the river runs past old mills where people trade grain and talk about rain".split()
    bad = ["#$%", "buy", "cl1ck", "||", "<<<", "now", "9999", "*&*"]
    texts = [" ".join(r.choice(good) + str(r.randint(0, 9)) for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += [" ".join(r.choice(bad) + str(r.randint(0, 99)) for _ in range(r.randint(40, 120))) for _ in range(80)]
    texts += ["same line\n" * 30, "a b c d " * 40, "é ü " * 60, "", None, " \n\t", "\x1c", texts[0], texts[0], "x" * 50_000 + " y" * 60]
    return texts


def test_quality_rules(spark, tmp_path):
    texts = some_texts(random.Random(1))
    labels = [(i, int(i < 150), 0) for i in range(0, 230, 3)]
    path = tables(spark, tmp_path, texts, labels)

    def grams(text):
        b = (text or "").encode()
        return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % (1 << 32)) >> 17 for i in range(len(b) - 3)]

    raw, good, trusted = Counter(), Counter(), {i for i, q, _ in labels if q}
    for i, text in enumerate(texts):
        own = Counter(grams(text))
        raw += own
        if i in trusted:
            good += own
    n = 1 << 15
    weight = lambda g: math.log((good[g] + 0.5) / (good.total() + 0.5 * n)) - math.log((raw[g] + 0.5) / (raw.total() + 0.5 * n))
    verdicts = Counter()
    for x in queries.op10_quality_rules(spark, path).collect():
        text = texts[x.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        repeat = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})
        lines = Counter(line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.values()) - len(lines), repeat)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        own = grams(text)
        ratio = sum(map(weight, own)) / len(own) if own else 0.0
        assert x.base_failed == failed and abs(x.llr - ratio) < 1e-4
        assert x.kept == (not failed and ratio >= quality.THRESHOLD) or abs(ratio - quality.THRESHOLD) < 1e-4
        verdicts[failed, x.kept] += 1
    assert sum(verdicts.values()) == len(texts) and verdicts[False, True] > 50 and verdicts[False, False] > 50 and verdicts[True, False] > 5


def test_shards_are_plain_scheduling(spark, tmp_path):
    """Every group here has 1/4096 of the bytes or more, so each is scheduled on its own; see the next test for bins."""
    texts = [t for t in some_texts(random.Random(2)) if t and 30 < len(t) < 5000]
    path = tables(spark, tmp_path, texts)
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5((t or "").encode()).hexdigest().upper()] += len((t or "").encode()) + 8
    assert min(groups.values()) * 4096 >= sum(groups.values())
    heap, shard = [(0, s) for s in range(24)], {}
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        load, s = heapq.heappop(heap)
        shard[key] = s
        heapq.heappush(heap, (load + size, s))
    rows = queries.op9_sharding(spark, path).collect()
    slots = defaultdict(list)
    for x in rows:
        data = (texts[x.doc_id] or "").encode()
        assert (x.shard, x.size, x.text_crc32, x.law, x.grown_shard) == (shard[hashlib.md5(data).hexdigest().upper()], len(data) + 8, zlib.crc32(data), "bytes", None)
        slots[x.shard].append(x.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_bins_come_near_to_plain_scheduling(spark):
    """With bins for the groups under 1/4096 of the bytes, the fullest shard has at most a thousandth more than its share."""
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    loads = Counter()
    for x in rows:
        loads[x.shard] += x.size
    assert max(loads.values()) <= 1.001 * loads.total() / 24 and len(loads) == 24


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the tables")
def test_toxicity_of_held_out_rows(spark):
    """On the largest table, for the smaller ones hold out six toxic rows or fewer."""
    path = "/root/testdata/sf0.1"
    docs, marked = read_table(spark, path, "documents"), {x.doc_id: x.toxic for x in read_table(spark, path, "labels").collect()}
    rows = queries.op6_toxicity(spark, path).collect()
    assert sorted(x.doc_id for x in rows) == sorted(x.doc_id for x in docs.select("doc_id").collect())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    seen = Counter((marked[x.doc_id], x.predicted) for x in rows if x.held_out and x.doc_id in marked)
    assert seen[1, 1] >= 0.8 * (seen[1, 0] + seen[1, 1]) and seen[0, 1] <= 0.01 * (seen[0, 0] + seen[0, 1])
