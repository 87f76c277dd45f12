"""Operators on texts against brute force, exact round trips and held-out accuracy, with the awkward rows."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from porelight.llm import bpe, chat, decontaminate, html_blocks, html_crf, html_training, licenses, quality, range_coder, sharding, simhash, token_files, toxicity
from porelight.llm.range_coder import decode_blocks, encode_blocks

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def awkward(spark):
    """Nulls, blanks, ties, repeated rows, one long text, and columns whose names the operators use inside."""
    texts = [None, "", " \n\t", "one", "a b c d e f", "a b c d e f", "é ü 日本 😀 " * 30, "word " * 30_000, "\x00 \x1c\x85", "<|im_end|>\n", None]
    df = docs_of(spark, texts, [1, 2, 3, 4, 5, 6, 7, 8, 9, None, 1])
    df = df.unionByName(df.where("doc_id = 5"))
    for name in ("fp", "id", "row", "key", "size", "shard", "item", "part", "kept", "score", "llr", "h", "w", "component", "ids"):
        df = df.withColumn(name, F.lit("x"))
    return df


LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def test_awkward_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], LABELS)
    items = spark.createDataFrame([(0, "a b c d e f"), (1, None), (2, ""), (None, "x y z"), (3, "one")], ITEMS)
    full = awkward(spark)
    for df in (full, full.limit(0)):
        n = df.count()
        none, noitems = labels.limit(0), items.limit(0)
        model = toxicity.fit_toxicity(df, labels)
        results = {
            "simhash": simhash.near_duplicates(df), "bpe": bpe.round_trip(df, RANKS, P.PATTERN), "license": licenses.scan(df), "toxicity": toxicity.score_toxicity(df, model), "toxicity0": toxicity.score_toxicity(df, toxicity.fit_toxicity(df, none)),
            "shards": sharding.shard_documents(df, n_shards=3), "quality": quality.score_quality(df, quality.fit_quality(df, labels)), "quality0": quality.score_quality(df, quality.fit_quality(df, none)), "tokens": token_files.token_digests(df, WORDS, part_bytes=60_000, block_ids=700),
        }
        for name, out in results.items():
            assert out.count() == n, name
        for kept in (quality.keep_quality(df, quality.fit_quality(df, none)), toxicity.keep_clean(df, model), simhash.drop_near_duplicates(df), decontaminate.clean(df, items), decontaminate.clean(df, noitems)):
            assert kept.columns == df.columns and kept.count() <= n
        leaks = {tuple(r)[:2] for r in decontaminate.find_leaks(df, items).collect()}
        assert leaks == ({(5, 0), (6, 0), (4, 3)} if n else set())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("hot", "block"), [(1 << 18, 1 << 10), (1 << 18, 7), (12, 6)])
def test_simhash(spark, hot, block):
    r = random.Random(2)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 120))) for _ in range(60)]
    texts = base + [t.replace(t.split()[-1], "changed", 1) for t in base] + base[:20] + ["", None, "A b C"]
    for _ in range(60):
        t = base[0].split() if len(base[0].split()) > 40 else base[1].split()
        t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
        texts.append(" ".join(t))
    df = docs_of(spark, texts)
    out = {x.doc_id: x for x in simhash.near_duplicates(df, hot=hot, block=block).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [out[i].component_id for i in range(len(texts))] == components(fps, 4)
    kept = {x.doc_id for x in simhash.drop_near_duplicates(df, hot=hot, block=block).collect()}
    assert kept == set(components(fps, 4))


def test_pigeonhole_plan():
    r = np.random.default_rng(0)
    bits = r.random((2000, 64)) < 0.5
    bits[:, 1] = bits[:, 0]
    both = bits.T.astype(int) @ bits.astype(int)
    groups = simhash.group_bits(2000, both, 5)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({0, 1} <= set(g) for g in groups)
    sizes = []
    for n in (10**4, 10**7, 10**9):
        parts = simhash.plan(n, both * (n // 2000), 4)
        assert sum(t for _, t in parts) >= 4 - len(parts) + 1 - (5 - len(parts))
        sizes.append(len(parts))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]
    cost, thresholds = simhash.allocate(2000, both, groups, 0)
    assert sum(thresholds) == 0


def test_star_links_find_all(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(4)]
    for _ in range(40):
        f = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 5)):
            f ^= 1 << b
        fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for distance in (2, 3):
        edges = simhash.star_links(spark.createDataFrame([(s,) for s in set(signed)], "fp long"), distance)
        from porelight.llm.components import components as connect

        roots = {x.node: x.root for x in connect(edges).collect()}
        label = [roots.get(s, s) for s in signed]
        want = components(fps, distance)
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


TEXT = st.text(st.sampled_from(list("ab 's're\n\t12é日! \x1c😀l")), max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_is_the_library(text):
    tree = _tree()
    ids = tree.encode(text)
    assert ids == tree.bpe.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


def _tree(made=[]):  # noqa: B006
    if not made:
        made.append(bpe.Codec(RANKS, P.PATTERN, 6, 4))
    return made[0]


def test_bpe_columns(spark):
    texts = ["Hello there, it's 42 !", None, "", "日本 " * 9000]
    df = docs_of(spark, texts)
    encoded = bpe.encode_documents(df, RANKS, P.PATTERN)
    decoded = {x.doc_id: bytes(x.bytes) for x in bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)}
    library = bpe.codec(RANKS, P.PATTERN).bpe
    for x in bpe.round_trip(df, RANKS, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[x.doc_id] or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49407) | st.integers(0, 3), max_size=400), max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    assert [b.tolist() for b in decode_blocks(encode_blocks(blocks))] == [b.tolist() for b in blocks]


def test_coder_learns_and_notices_damage():
    ids = np.tile(np.arange(300) * 7, 12)
    big = np.array([(1 << 20) + k % 5 for k in range(300)])
    blob = encode_blocks([ids])[0]
    assert len(blob) < 0.5 * 2 * len(ids)
    assert decode_blocks(encode_blocks([big], 24), 24)[0].tolist() == big.tolist()
    for at in (0, 5, 12, 40, len(blob) - 4):
        bad = bytearray(blob)
        bad[at] ^= 16
        try:
            out = decode_blocks([bytes(bad)])
        except ValueError:
            continue
        assert out[0].tolist() == ids.tolist()  # the last bits of a block may not matter


def test_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    r = random.Random(0)
    special = ["a plain<|endoftext|>text", "<|startoftext|>b<|endoftext|><|endoftext|> c", "<|EndOfText|> <|STARTOFTEXT|> <| endoftext |>", "<|endoftext|>"]
    assert all(tokenizer.token_to_id(t) in tokenizer.encode(t, add_special_tokens=False).ids for t in ("<|startoftext|>", "<|endoftext|>"))
    texts = [*special, "Don't stop; it's 2024!", None, "", "<|endoftext|> ünï İstanbul ½ ſ", "日本語 test x \x1c y"] + [" ".join(r.choice(["alpha", "Beta's", "ΓΔ", "12", "--", "é"]) for _ in range(r.randint(0, 900))) for _ in range(40)]
    order = list(range(len(texts)))
    r.shuffle(order)
    out = {x.doc_id: x for x in token_files.token_digests(docs_of(spark, [texts[i] for i in order], order), WORDS, part_bytes=20_000, block_ids=333, lanes=5).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


def test_new_words_go_to_the_model_alone(monkeypatch):
    marks = "".join(map(chr, [*range(33, 127), *range(0xA1, 0x130), *range(0x131, 0x180)])).replace("\xad", "")
    texts = ["", None, "Straße don't 10½ x", " ".join(marks), marks, "\xad tower", *(f"w{k}ö the" for k in range(300))]
    encoder = token_files.WordEncoder(WORDS, 1, "<u2")
    want = [encoder._whole(t or "") + encoder.end for t in texts]
    monkeypatch.setattr(token_files.WordEncoder, "_whole", lambda *_: pytest.fail("a text was given to the library whole"))

    class ModelOnly:
        def __getattr__(self, name):
            raise AssertionError(f"{name}: new words are encoded by the model, without the library's steps around it")

    encoder.tokenizer = encoder.apart = ModelOnly()
    assert encoder.encode_all(pa.array(texts, pa.string())).to_pylist() == want


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(token_files.WordEncoder, "MOST", 6)
    monkeypatch.setattr(token_files.WordEncoder, "ROWS", 2)
    encoder = token_files.WordEncoder(WORDS, 1, "<u2")
    texts = [t for k in range(8) for t in (f"the cat saw w{chr(97 + k)} and x{chr(98 + k)}", None, f" the,{k} don't\n")]
    found = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(pa.array(texts)).to_pylist()]
    assert found == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    encoder.encode_all(pa.array(["the q r s t u v y z"]))
    assert "the" in encoder.words and len(encoder.words) < 6 + 12
    assert encoder.encode_all(pa.array([], pa.string())).to_pylist() == []


def test_an_id_is_one_step_of_the_coder(monkeypatch):
    steps, put = [], range_coder.Encoder.put
    monkeypatch.setattr(range_coder.Encoder, "put", lambda *a: (steps.append(1), put(*a))[1])
    r = np.random.default_rng(5)
    blocks = [r.integers(0, 1 << 16, n).astype("<u2") for n in (700, 700, 1, 0, 300)] + [np.repeat(r.integers(0, 9, 70), 10).astype("<u2")]
    for kind, most in (("<u2", 700), ("<u4", 1400)):
        steps.clear()
        coded = encode_blocks([b.astype(kind) for b in blocks], 8 * np.dtype(kind).itemsize)
        assert len(steps) <= most
        assert [x.tolist() for x in decode_blocks(coded, 8 * np.dtype(kind).itemsize)] == [b.tolist() for b in blocks]
    wide = [r.integers(0, 1 << 31, 600).astype("<u4")]
    assert decode_blocks(encode_blocks(wide, 32), 32)[0].tolist() == wide[0].tolist()


def test_steps_are_prepared_together_and_bytes_stay(monkeypatch):
    calls, slots = [], range_coder.Lanes.slots
    monkeypatch.setattr(range_coder.Lanes, "slots", lambda *a: (calls.append(1), slots(*a))[1])
    r = np.random.default_rng(7)
    blocks = [np.minimum(r.zipf(1.3, n), 65535).astype("<u2") for n in (1100, 1100, 900, 40)]
    coded = encode_blocks(blocks)
    assert len(calls) <= 1100 // 32 + 5
    assert hashlib.md5(b"".join(coded)).hexdigest() == "a2cafeccc966f2edeeb1386c8b15acd2"
    assert [x.tolist() for x in decode_blocks(coded)] == [b.tolist() for b in blocks]
    wide = [np.minimum(r.zipf(1.1, n), 1 << 30).astype("<u4") for n in (600, 80)]
    coded = encode_blocks(wide, 32)
    assert hashlib.md5(b"".join(coded)).hexdigest() == "80e16987e2258a33d821e5e13fbb88e2"
    assert [x.tolist() for x in decode_blocks(coded, 32)] == [b.tolist() for b in wide]


def test_odd_texts_go_to_the_library_whole():
    encoder = token_files.WordEncoder(WORDS, 1, "<u2")
    texts = ["plain", None, "İ dot", "a\x00b", "a\x7f", "日本 語", "x <|EndOfText|> y", "", "ſ Straße", "\u2028", "<|startoftext|"]
    want = [encoder._whole(t or "") + encoder.end for t in texts]
    seen, whole = [], encoder._whole
    encoder._whole = lambda t: (seen.append(t), whole(t))[1]
    assert encoder.encode_all(pa.array(texts, pa.string())).to_pylist() == want
    assert seen == [t for k, t in enumerate(texts) if k in (2, 3, 4, 5, 6, 9)]


def test_token_files_are_read_back(spark, tmp_path):
    texts = ["one two three", "", "four"]
    token_files.write_tokens(docs_of(spark, texts), f"{tmp_path}/t", WORDS)
    rows = token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("id").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    assert [x.ids for x in rows] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_shards(spark):
    r = random.Random(1)
    texts = ["copy " * 30] * 200 + ["x" * r.randint(0, 400) + str(i) for i in range(700)]
    out = sharding.shard_documents(docs_of(spark, texts), n_shards=7, bins=64, max_heavy=32).toPandas()
    assert len(out) == 900 and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert out[out.doc_id < 200].shard.nunique() == 1
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    for x in out.itertuples():
        assert (x.size, x.text_crc32) == (len(texts[x.doc_id].encode()) + 8, zlib.crc32(texts[x.doc_id].encode()))
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def brute_quality(text):
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\t#|é ")), max_size=80))
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == brute_quality(text.encode())


def test_quality_verdict(spark):
    r = random.Random(0)
    good = [" ".join(r.choice("the cat sat on a mat and then it ran off again".split()) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join("#" * 3 + str(r.randint(0, 99)) + "$%" for _ in range(80)) for _ in range(30)]
    df = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 90, 2)], LABELS)
    weights = quality.fit_quality(df, labels)
    kept = {x.doc_id for x in quality.score_quality(df, weights).where("kept").collect()}
    assert kept == {x.doc_id for x in quality.keep_quality(df, weights).collect()} == set(range(60))
    raw = np.zeros(quality.BUCKETS)
    for t in good + bad:
        np.add.at(raw, quality.buckets_of(t.encode()), 1)
    assert quality.ngram_counts(df, [0], "doc_id", "text")[1].tolist() == raw.tolist()


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    entries = [("idiot", False, 3.0), ("worthless", False, 4.0), ("scum", False, 2.0), ("lowe", True, 5.0)]
    matcher, r = toxicity.Matcher(entries), random.Random(0)
    for _ in range(4000):
        word = list(r.choice(["idiot", "worthless", "scum", "lowei", "house"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = r.choice(["", "x", "o"])
        word = "".join(word)
        near = [(d, -w) for e, s, w in entries if not s and (d := distance(word, e)) <= toxicity.edits_for(e, s)]
        stem = 5.0 if word.startswith("lowe") else 0.0
        weight, edits, _ = matcher.match(word)
        exact = [w for d, w in near if d == 0]
        if exact:
            assert (weight, edits) == (-exact[0], 0), word
        elif stem:
            assert (weight, edits) == (stem, 0), word
        else:
            assert (weight, edits) == ((-min(near)[1], min(near)[0]) if near else (0.0, 0)), word


def test_toxicity_held_out(spark):
    r = random.Random(3)
    words = "the road to town is long and green trees stand by it while people walk home in rain".split()
    rows, labels = [], []
    for i in range(500):
        text = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for w in r.sample(["blargh", "snotface", "gruntbag"], 2):
                text[r.randrange(40)] = w
        rows.append(" ".join(text))
        labels.append((i, 1, int(toxic)))
    extra = {500: "you are a snotfacee and a gruntbga", 501: 'the word "blargh" is an insult they said', 502: "people walk home", 503: "such a sn0tface and a bl@rgh"}
    df = docs_of(spark, rows + list(extra.values()))
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, LABELS))
    out = {x.doc_id: x for x in toxicity.score_toxicity(df, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in range(500))
    assert all(out[i].predicted == int(i % 5 == 0) for i in held)
    assert [out[i].predicted for i in (500, 501, 502, 503)] == [1, 0, 0, 1]
    assert out[501].score > out[502].score
    # labels of held-out rows don't matter
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    assert toxicity.fit_toxicity(df, spark.createDataFrame(flipped, LABELS)) == model


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    w, v = r.normal(size=(len(html_blocks.NAMES), 2)), r.normal(size=(2, 2))
    for _ in range(30):
        f = [sorted(set(r.integers(0, len(w), 5).tolist())) for _ in range(7)]
        score = lambda y: sum(w[x, a].sum() for x, a in zip(f, y)) + sum(v[a, b] for a, b in zip(y, y[1:]))
        best = max(range(128), key=lambda k: score([k >> i & 1 for i in range(7)]))
        assert html_crf.viterbi(f, (w, v)) == [best >> i & 1 for i in range(7)]


def test_pages_held_out():
    weights = html_crf.fitted()
    wrong = blocks = 0
    for features, labels in html_crf.examples(html_training.labelled_pages(120, 12345)):
        blocks += len(labels)
        wrong += sum(a != b for a, b in zip(labels, html_crf.viterbi(features, weights)))
    assert wrong / blocks < 0.01


def test_page_rules(spark):
    page = """<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body>
    <nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <article><h1>A title</h1><p>Some   <b>bo</b>ld &amp; plain&nbsp;text.<br>More <!-- hidden --> here<p>Unclosed paragraph follows.
    <aside><p>Related things</p></aside><form><label>Mail</label><button>Send</button></form></article>
    <section class="comments"><div class="comment"><p>I disagree with all of this.</p></div></section><footer>&copy; 2024</footer>"""
    out = html_crf.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "", ""), (4, "", "<p"), (5, "", "<<>> &#x41; </p></div>")], "page_id long, url string, html string"), carry=("url",)).collect()
    texts = {x.page_id: x.text for x in out}
    assert texts[1] == "A title Some bold & plain text. More here Unclosed paragraph follows."
    assert texts[2] == texts[3] == texts[4] == "" and all(x.n_chars == len(x.text) for x in out)




def test_chat_round_trip(spark):
    r = random.Random(9)
    bits = ["<|im_start|>", "<|im_end|>\n", "\\", "[INST]", "</s>", "a", "\n", "<", "|", "<<SYS>>", "é", " ", "\\n"]
    said = [(c, t, r.choice(["user", "assistant", "system", "to\nol", None, "human", "<|im_end|>"]), None if r.random() < 0.1 else "".join(r.choices(bits, k=r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 5))]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows, "conv_id")
    formatted = chat.format_turns(turns)
    a = {x.id: [tuple(t) for t in x.turns] for x in turns.collect()}
    b = {x.id: [tuple(t) for t in x.turns] for x in chat.read_turns(formatted).collect()}
    assert a == b
    for x in formatted.collect():
        at, loss = 0, []
        for run in x.loss_mask:
            if run.loss:
                loss.append(x.formatted[at : at + run.chars])
            at += run.chars
        assert at == len(x.formatted)
        assert len(loss) == sum(role == "assistant" for role, _ in a[x.id])
    assert {role for t in a.values() for role, _ in t} >= {"user", "assistant", "", "to\nol"}


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "p", "completion": "c"}, {"response": "r", "prompt": "p"},
        {"instruction": "i", "input": "more", "output": "o"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "output": 5}, {"question": "q", "answer": "a"}, {"other": 1}, {"messages": []},
    ]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)] + [(98, "not json"), (99, None)], "k int, j string")
    out = {x.id: (x.layout, [tuple(t) for t in x.turns]) for x in chat.canonical_json(df, "k", "j").collect()}
    assert out[0] == ("messages", [("user", "hi"), ("assistant", "")]) and out[1] == ("share", [("user", "q"), ("assistant", "a")])
    assert out[2][1] == [("user", "p"), ("assistant", "c")] and out[3][1] == [("user", "p"), ("assistant", "r")]
    assert out[4][1] == [("user", "i\n\nmore"), ("assistant", "o")] and out[5][1] == [("user", "i"), ("assistant", "o")]
    assert out[6] == ("instruction", [("user", "i"), ("assistant", "5")]) and out[7][1] == [("user", "q"), ("assistant", "a")]
    assert out[8] == out[98] == out[99] == (None, [])
    typed = spark.createDataFrame([(1, "q", "a")], "k int, question string, answer string")
    assert chat.canonical_turns(typed, "k").first().layout == "question_answer"
    assert chat.canonical_turns(typed, "k", ["question"]).first().layout is None


def test_chat_awkward(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", None), (None, 0, None, None), (2, 0, "user", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    for name in ("id", "row", "rows", "turns", "formatted", "layout", "pairs", "parts"):
        rows = rows.withColumn(name, F.lit("z"))
    out = {x.conv_id: x for x in chat.digests(chat.read_turns(chat.format_turns(chat.canonical_turns(rows, "conv_id"))), "conv_id").collect()}
    assert {k: (v.n_turns, v.loss_chars) for k, v in out.items()} == {1: (4, 1), None: (1, 0), 2: (1, 0)}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nuser\na\nuser\na\nassistant\nb\n").hexdigest()
    assert chat.digests(chat.read_turns(chat.format_turns(chat.canonical_turns(rows.limit(0), "conv_id"))), "conv_id").count() == 0


def test_chat_loss_is_read_under_the_mask(spark):
    rows = spark.createDataFrame([(1, 0, "user", "<s>é\\"), (1, 1, "assistant", "</s>\U0001f600b"), (1, 2, "assistant", "<|im_end|>\n"), (2, 0, "assistant", None), (3, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.canonical_turns(rows, "conv_id"))
    other = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda r, k: F.struct(r["chars"].alias("chars"), ((k % 3 == 1) & ~r["loss"]).alias("loss"))))
    for table, want in ((formatted, {1: "</s>\U0001f600b<|im_end|>\n", 2: "", 3: ""}), (other, {1: "<s>é\\", 2: "", 3: "q"})):
        out = {x.conv_id: (x.loss_chars, x.loss_sha256) for x in chat.digests(chat.read_turns(table), "conv_id").collect()}
        assert out == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    for wrong in (F.slice("loss_mask", 1, 2), F.transform("loss_mask", lambda r: F.struct((r["chars"] + 1).alias("chars"), r["loss"].alias("loss")))):
        with pytest.raises(Exception, match="does not fit"):
            chat.digests(chat.read_turns(formatted.withColumn("loss_mask", wrong)), "conv_id").collect()


def test_licenses(spark):
    mit = next(t for i, t in licenses.notices() if i == "MIT")
    texts = ["Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  "), mit + " more", "x\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0", "Copyright 2020", "", None, mit.replace("sublicense", "sub-license")]
    out = {x.doc_id: (x.text_license, x.line_licenses, x.n_license_lines) for x in licenses.scan(docs_of(spark, texts)).collect()}
    assert out[0][0] == "MIT" and out[6][0] == "MIT" and out[1][0] == ""
    assert out[2] == ("", "CC-BY-NC-4.0,MIT", 2) and out[3] == out[4] == out[5] == ("", "", 0)
    own = {x.doc_id: x.text_license for x in licenses.scan(docs_of(spark, ["My, licence!"]), [("b", "my license"), ("a", "MY LICENSE")]).collect()}
    assert own[0] == "a,b"


def test_leaks_are_brute_force(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 300)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 6, 9, 20, 40, 41, 90])] + [(50, "a a a a a a a a")]
    docs = []
    for _ in range(120):
        own = [word() for _ in range(r.randint(0, 300))]
        if r.random() < 0.6:
            text = r.choice(items)[1].split()
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = word()
            text = text[: r.randint(len(text) * 2 // 3, len(text))]
            at = r.randint(0, len(own))
            own[at:at] = text
        docs.append("  ".join(own).upper())

    docs += ["x " * 20_000 + "w1 w2  W3 " + "x " * 20_000, "alone", ""]
    items += [(60, "w1 W2 w3"), (61, "alone"), (62, " "), (None, "x x x x x x"), (None, "W3 x x x x"), (61, "x w1")]

    def grams(text, n):
        w = text.lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    want = {(d, k) for d, t in enumerate(docs) for k, i in items if (n := min(5, len(i.split()))) and len(grams(t, n) & grams(i, n)) >= 0.8 * len(grams(i, n)) - 1e-9}
    assert {(120, 60), (120, None), (120, 61), (121, 61)} <= want
    table = spark.createDataFrame(items, ITEMS)
    for most in (10**6, 0):
        got = decontaminate.find_leaks(docs_of(spark, docs), table, max_broadcast=most)
        assert {tuple(x)[:2] for x in got.collect()} == want
    assert {x.doc_id for x in decontaminate.clean(docs_of(spark, docs), table).collect()} == set(range(123)) - {d for d, _ in want}
