"""The coder on the JVM against the one in numpy, whose bytes are the format."""

import numpy as np
import public_tokenizers as P
import pytest

from porelight.llm import block_coder, token_files
from porelight.llm.range_coder import decode_blocks, encode_blocks

WORDS = P.path("word_bpe_49k.json")


def passed(spark, function, blocks, id_bits):
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blocks)], "k int, data binary").repartition(2)
    found = dict(df.withColumn("data", function(spark, "data", id_bits)).collect())
    return [bytes(found[k]) for k in range(len(blocks))]


@pytest.mark.parametrize(("id_bits", "kind"), [(16, "<u2"), (24, "<u4"), (32, "<u4")])
def test_bytes_are_those_of_the_numpy_coder(spark, id_bits, kind):
    r, top = np.random.default_rng(id_bits), (1 << id_bits) - 1
    blocks = [r.integers(0, top, n, endpoint=True).astype(kind) for n in (0, 1, 2, 700, 2048, 2500)]
    blocks += [np.minimum(r.zipf(1.3, n), top).astype(kind) for n in (1100, 2048, 40)]
    blocks += [np.zeros(3000, kind), np.full(2000, top, kind), np.tile(r.integers(0, top, 70).astype(kind), 30), np.repeat(r.integers(0, 9, 70), 10).astype(kind)]
    want = encode_blocks(blocks, id_bits)
    assert passed(spark, block_coder.encoded, [b.tobytes() for b in blocks], id_bits) == want
    assert passed(spark, block_coder.decoded, want, id_bits) == [b.tobytes() for b in blocks]


def test_long_blocks_and_nulls(spark):
    r = np.random.default_rng(2)
    long = [np.minimum(r.zipf(1.2, n), 65535).astype("<u2").tobytes() for n in ((1 << 16) - 1, 1 << 16, (1 << 16) + 1, 200_001)]
    assert passed(spark, block_coder.decoded, passed(spark, block_coder.encoded, long, 16), 16) == long
    null = spark.createDataFrame([(None,)], "data binary")
    assert null.select(block_coder.encoded(spark, "data")).first()[0] is None and null.select(block_coder.decoded(spark, "data")).first()[0] is None


def test_damage_ends_the_query(spark):
    ids = np.tile(np.arange(300, dtype="<u2") * 7, 12)
    blob = encode_blocks([ids])[0]
    for at in (0, 4, 6, 7, 9, 12, 15, 16, 40, len(blob) // 2):  # the head, the number of ids, of words, the sum, the words
        for bit in (1, 64):
            bad = bytearray(blob)
            bad[at] ^= bit
            with pytest.raises(Exception, match="block of token ids"):
                passed(spark, block_coder.decoded, [bytes(bad)], 16)
    for bad in (b"", blob[:10], blob[:16], blob[:-2], blob + b"\0\0"):
        with pytest.raises(Exception, match="not a whole block of token ids"):
            passed(spark, block_coder.decoded, [bad], 16)


def test_files_are_coded_by_the_executors_jvms(spark, tmp_path):
    texts = [f"the {k % 37} cat sat on mat {k}" for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, f"{tmp_path}/t", WORDS, part_bytes=8_000, block_ids=300)
    read = token_files.read_tokens(spark, f"{tmp_path}/t")
    assert "porelight_decode_16" in read._jdf.queryExecution().toString()
    rows = spark.read.parquet(f"{tmp_path}/t").orderBy("part", "block").collect()
    stream = np.concatenate(decode_blocks([bytes(x.data) for x in rows]))  # what the files hold is the numpy coder's
    assert [bytes(x.data) for x in rows] == encode_blocks(np.split(stream, np.cumsum([x.n for x in rows])[:-1]))
    assert [i for x in read.orderBy("id").collect() for i in x.ids] == stream.tolist()
