"""Codecs: golden vectors, round trips, and every guard."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from porelight.functions import codec, codewords
from porelight.functions.codewords import coders

CODES = coders()


@pytest.mark.parametrize(
    "name, values, data",
    [
        ("ed_skip", [0, 0, 5, 0], "000000000000000002050000000000000002"),
        ("ed_len", [8, 5, 120, 7], "080000000000000007b401780000000000000002b401"),
        ("fq_bp", [ord(c) for c in "ACGTNA"], "41b6034e1c"),
        ("fq_qv", [10, 31, 0, 7], "0a7e3c06"),
        ("ev_rel_skip", [0, 0, 1, 0], "000000000000000002010000000000000002"),
        ("ev_move", [0, 1, 2, 3, 1], "00ed031d"),
    ],
)
def test_golden(name, values, data):
    packed, params = codec.huffman_encode(values, CODES[name])
    assert packed.hex() == data
    assert codec.huffman_decode(packed, params, CODES[name]) == values


def test_bits():
    assert codec.bit_encode([0, 1, 2, 3, 3], 2)[0].hex() == "e403"
    assert codec.bit_encode([1, 0, 1, 1, 0, 0, 0, 1, 1], 1)[0].hex() == "8d01"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-300, 300)), st.sampled_from(["rw", "ed_skip", "ed_len", "ev_rel_skip"]))
def test_round_trip(values, name):
    assert codec.huffman_decode(*codec.huffman_encode(values, CODES[name]), CODES[name]) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535)), st.integers(1, 16))
def test_bit_round_trip(values, bits):
    assert codec.bit_decode(*codec.bit_encode(values, bits)) == [v % (1 << bits) for v in values]


def test_guards():
    code = CODES["ed_len"]
    data, params = codec.huffman_encode([8, 5, 120], code)
    for key, value in (("packer", "x"), ("format_version", "1"), ("codeword_map_name", "y")):
        with pytest.raises(ValueError):
            codec.huffman_decode(data, params | {key: value}, code)
    with pytest.raises(ValueError):
        codec.huffman_decode(data, params | {"size": "2"}, code)
    with pytest.raises(ValueError):
        codec.huffman_decode(data[:5], params, code)
    with pytest.raises(ValueError, match="overflows"):
        codec.huffman_decode(bytes([127, 0b11]) + bytes(3), {"packer": "huffman_packer", "format_version": "2", "codeword_map_name": "t", "code_diff": "1", "size": "2"}, codewords.Code("t", {"1": "1", ".": "0"}, 1, True))
    packed, params = codec.bit_encode([1, 2, 3], 2)
    with pytest.raises(ValueError):
        codec.bit_decode(packed + b"\0", params)


def test_codes():
    for name, code in CODES.items():
        assert sum(2.0 ** -len(c) for c in code.table.values()) == 1.0, name
    with pytest.raises(ValueError):
        codewords.Code("x", {"1": "0", ".": "01"}, 1)
    with pytest.raises(ValueError):
        codewords.Code("x", {"1": "0" * 60, ".": "1"}, 1)
    assert codewords.load(["1 0", ". 1", ""]) == {"1": "0", ".": "1"}


def test_training():
    trained = codewords.train({0: 10, 1: 3}, 0, 2)
    assert trained[0] == ("0", "1") or trained[0][1] in ("0", "1")
    assert {s for s, _ in trained} == {".", "0", "1", "2"}
    assert sum(2.0 ** -len(c) for _, c in trained) == 1.0


def test_columns(spark):
    df = spark.createDataFrame([(1, [5, 6, 900]), (2, []), (3, None)], "k int, v array<bigint>")
    out = df.select("k", codec.unpack_huffman(spark, codec.pack_huffman(spark, F.col("v"), CODES["rw"]), CODES["rw"]).alias("v"))
    assert dict(map(tuple, out.collect())) == {1: [5, 6, 900], 2: [], 3: None}
    bits = df.where("k < 3").select("k", codec.unpack_bits(spark, codec.pack_bits(spark, F.col("v"), 10)).alias("v"))
    assert dict(map(tuple, bits.collect())) == {1: [5, 6, 900], 2: []}


def test_many_reads_at_once():
    """The streams of many reads encoded at once are those of each alone, in a fraction of the time."""
    import time

    import numpy as np

    from porelight.functions import codec
    from porelight.functions.codewords import coders

    rng, seconds = np.random.default_rng(3), [0.0, 0.0]
    for name, code in coders().items():
        low, high = {"rw": (400, 600), "ed_skip": (0, 4), "ed_len": (0, 140), "fq_bp": (65, 90), "fq_qv": (0, 40), "ev_move": (0, 12)}.get(name, (0, 6))
        arrays = [rng.integers(low, high, n) for n in [0, 1, 0, 2, 300_000, 0, *rng.integers(0, 9, 3000).tolist(), 0]]
        began = time.perf_counter()
        got = codec.huffman_encode_all(arrays, code)
        seconds[0] += time.perf_counter() - began
        began = time.perf_counter()
        want = [codec.huffman_encode(a, code)[0] for a in arrays]
        seconds[1] += time.perf_counter() - began
        assert got == want, name
    assert codec.huffman_encode_all([np.zeros(0, int)] * 2, coders()["rw"]) == [b"", b""] and codec.huffman_encode_all([], coders()["rw"]) == []
    with pytest.raises(OverflowError):
        codec.huffman_encode_all([np.array([1 << 40])], coders()["rw"])
    for bits in (1, 2, 5):
        arrays = [rng.integers(0, 1 << bits, n) for n in (0, 1, 7, 8, 9, 200_000, 0)]
        assert codec.bit_encode_all(arrays, bits) == [codec.bit_encode(a, bits)[0] for a in arrays]
    assert seconds[0] < seconds[1]
