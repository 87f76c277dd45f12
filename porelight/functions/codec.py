"""Packed streams: prefix codes and fixed-width bits, as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from porelight.functions.codewords import FORMAT_VERSION, Code
from porelight.runtime import ship_package

STREAM = "struct<bytes: binary, params: map<string,string>>"


def huffman_encode(values, code: Code) -> tuple[bytes, dict[str, str]]:
    """The first value as it is, then codes from the lowest bit up; an escape and padding go before each value without a code, and at the end.

    Values between two escapes are coded at once.
    """
    v = np.asarray(values, np.int64)
    symbols, words, lengths = _tables(code)
    coded = np.diff(v) if code.diff else v[1:]
    at = np.minimum(np.searchsorted(symbols, coded), len(symbols) - 1)
    starts = np.concatenate(([0], 1 + np.flatnonzero(symbols[at] != coded), [len(v)])) if len(v) else np.zeros(1, int)
    out = bytearray()
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):  # a value as it is, and those with a code up to the next without
        own = at[lo : hi - 1]
        word, length = np.append(words[own], np.uint64(code.escape[0])), np.append(lengths[own], code.escape[1])
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) - np.repeat(ends - length, length)
        bits = (np.repeat(word, length) >> place.astype(np.uint64)) & np.uint64(1)
        out += int(v[lo]).to_bytes(code.width, "little", signed=code.signed) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    average = f"{len(out) * 8 / len(v):.2f}" if len(v) else "nan"
    return bytes(out), {"packer": "huffman_packer", "format_version": FORMAT_VERSION, "codeword_map_name": code.name, "code_diff": str(int(code.diff)), "size": str(len(v)), "avg_bits": average}


def _tables(code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in order with their words and lengths, made once a code."""
    if not hasattr(code, "arrays"):
        order = sorted(code.words)
        code.arrays = np.array(order, np.int64), np.array([code.words[s][0] for s in order], np.uint64), np.array([code.words[s][1] for s in order], np.int64)
    return code.arrays


def check_params(params: dict[str, str], code: Code) -> None:
    for key, due in (("packer", "huffman_packer"), ("format_version", FORMAT_VERSION), ("codeword_map_name", code.name)):
        if params.get(key) != due:
            raise ValueError(f"stream attribute {key} is {params.get(key)!r}, not {due!r}")


_WINDOW = 16


def _decoder(code: Code):
    """A function from a window of bits to (symbols that end in it, bits they take, whether an escape follows), remembered for each window met."""
    if hasattr(code, "decoder"):
        return code.decoder
    by_code = {(length, bits): s for s, (bits, length) in code.words.items()} | {(code.escape[1], code.escape[0]): None}
    lengths, seen = sorted({length for length, _ in by_code}), {}

    def decode(window: int):
        if window not in seen:
            found, used = [], 0
            while True:
                length = next((n for n in lengths if used + n <= _WINDOW and (n, window >> used & ((1 << n) - 1)) in by_code), None)
                if length is None:
                    seen[window] = found, used, False
                    break
                symbol = by_code[length, window >> used & ((1 << length) - 1)]
                used += length
                if symbol is None:
                    seen[window] = found, used, True
                    break
                found.append(symbol)
        return seen[window]

    def longer(bits: int, left: int):
        """A code that no window holds: its symbol and length."""
        length = next((n for n in lengths if n <= left and (n, bits & ((1 << n) - 1)) in by_code), None)
        if length is None:
            raise ValueError("unknown codeword")
        return by_code[length, bits & ((1 << length) - 1)], length

    code.decoder = decode, longer
    return code.decoder


def huffman_decode(data: bytes, params: dict[str, str], code: Code) -> list[int]:
    check_params(params, code)
    size, diff = int(params["size"]), params["code_diff"] == "1"
    low, high = (-(1 << 8 * code.width - 1), (1 << 8 * code.width - 1) - 1) if code.signed else (0, (1 << 8 * code.width) - 1)
    decode, longer = _decoder(code)
    out: list[int] = []
    at, n, mask = 0, 8 * len(data), (1 << _WINDOW) - 1
    while size:
        if at % 8 or at + 8 * code.width > n:
            raise ValueError("a stream ends inside a value")
        first, found, escaped = int.from_bytes(data[at // 8 : at // 8 + code.width], "little", signed=code.signed), [], False
        at += 8 * code.width
        while not escaped:
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & mask
            symbols, used, escaped = decode(window)
            if not used:
                symbol, used = longer(int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7), n - at)
                symbols, escaped = ([], True) if symbol is None else ([symbol], False)
            if at + used > n:
                raise ValueError("unknown codeword")
            found += symbols
            at += used
        at = -(-at // 8) * 8
        values = np.cumsum([first, *found]) if diff else np.array([first, *found], np.int64)
        outside = values[(values < low) | (values > high)]
        if len(outside):
            raise ValueError(f"value {outside[0]} overflows {code.width} bytes")
        out += values.tolist()
        if at >= n:
            break
    if len(out) != size:
        raise ValueError(f"stream has {len(out)} values, not {size}")
    return out


def bit_encode(values, num_bits: int, width: int = 2) -> tuple[bytes, dict[str, str]]:
    """``num_bits`` of each value, lowest bit first; no more than the type has."""
    num_bits = min(num_bits, 8 * width)
    v = np.asarray(values, np.uint64)
    bits = (v[:, None] >> np.arange(num_bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), {"packer": "bit_packer", "num_bits": str(num_bits), "size": str(len(v))}


def bit_decode(data: bytes, params: dict[str, str]) -> list[int]:
    if params.get("packer") != "bit_packer":
        raise ValueError("not a bit-packed stream")
    size, num_bits = int(params["size"]), int(params["num_bits"])
    if len(data) != -(-size * num_bits // 8):
        raise ValueError(f"{len(data)} bytes can't hold {size} values of {num_bits} bits")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: size * num_bits].reshape(size, num_bits)
    return (bits.astype(np.uint64) << np.arange(num_bits, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64).tolist() if size else []


#: Values that are encoded at once, of many reads.
_AT_ONCE = 1 << 17


def _at_once(arrays: list[np.ndarray]):
    """Runs of arrays of ``_AT_ONCE`` values in all, or one that is longer."""
    own, n = [], 0
    for a in arrays:
        if own and n + len(a) > _AT_ONCE:
            yield own
            own, n = [], 0
        own.append(a)
        n += len(a)
    if own:
        yield own


def _placed_bits(words: np.ndarray, lengths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes the low bits of each word, lowest first, from a place among the bits of ``out``."""
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    out[np.repeat(at, lengths) + place] = (np.repeat(words, lengths) >> place.astype(np.uint64)) & np.uint64(1)


def huffman_encode_all(arrays: list[np.ndarray], code: Code) -> list[bytes]:
    """The bytes of ``huffman_encode`` of each array, of many at once."""
    return [b for own in _at_once(arrays) for b in _huffman_encode_some(own, code)]


def _huffman_encode_some(arrays: list[np.ndarray], code: Code) -> list[bytes]:
    v, sizes = np.concatenate(arrays).astype(np.int64, copy=False), np.array([len(a) for a in arrays])
    if not len(v):
        return [b""] * len(arrays)
    symbols, words, lengths = _tables(code)
    begins = np.zeros(len(v), bool)
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    coded = np.diff(v, prepend=0) if code.diff else v
    at = np.minimum(np.searchsorted(symbols, coded), len(symbols) - 1)
    whole = begins | (symbols[at] != coded)  # values that stand as they are, each the start of a segment
    starts = np.flatnonzero(whole)
    raw = v[starts]
    least, most = (-(1 << 8 * code.width - 1), (1 << 8 * code.width - 1) - 1) if code.signed else (0, (1 << 8 * code.width) - 1)
    if raw.min() < least or raw.max() > most:
        raise OverflowError(f"a value does not fit {code.width} bytes")
    own = np.where(whole, 0, lengths[at])
    ran = np.cumsum(own) - own
    bits = np.add.reduceat(own, starts)
    space = code.width + (bits + code.escape[1] + 7) // 8
    offset = np.cumsum(space) - space
    segment = np.cumsum(whole) - 1
    first = 8 * (offset + code.width)  # bit of a segment's first code
    out = np.zeros(8 * int(space.sum()), np.uint8)
    rest = ~whole
    _placed_bits(words[at[rest]], own[rest], (first[segment] + ran - ran[starts][segment])[rest], out)
    _placed_bits(np.full(len(starts), code.escape[0], np.uint64), np.full(len(starts), code.escape[1]), first + bits, out)
    packed = np.packbits(out, bitorder="little")
    packed[offset[:, None] + np.arange(code.width)] = raw.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : code.width]
    ends = np.append(offset, len(packed))[np.append(0, np.cumsum(np.add.reduceat(whole, (np.cumsum(sizes) - sizes)[sizes > 0])))]
    data, out_bytes, k = packed.tobytes(), [], 0
    for n in sizes.tolist():
        out_bytes.append(data[ends[k] : ends[k + 1]] if n else b"")
        k += n > 0
    return out_bytes


def bit_encode_all(arrays: list[np.ndarray], num_bits: int, width: int = 2) -> list[bytes]:
    """The bytes of ``bit_encode`` of each array, of many at once."""
    num_bits, out = min(num_bits, 8 * width), []
    for own in _at_once(arrays):
        v, sizes = np.concatenate(own).astype(np.uint64), np.array([len(a) for a in own])
        space = (sizes * num_bits + 7) // 8
        offset = np.append(0, np.cumsum(space))
        bits = np.zeros(8 * int(offset[-1]), np.uint8)
        place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _placed_bits(v, np.full(len(v), num_bits), 8 * np.repeat(offset[:-1], sizes) + num_bits * place, bits)
        data = np.packbits(bits, bitorder="little").tobytes()
        out += [data[lo:hi] for lo, hi in zip(offset.tolist(), offset[1:].tolist())]
    return out


def _stream(encode, values: Column, fixed: dict[str, str], averaged: bool) -> Column:
    """``STREAM`` of an encoder of many values: what streams differ in comes from Python, their map is put together outside of it."""

    @F.pandas_udf("struct<bytes: binary, size: string, average: string>")
    def pack(values: pd.Series) -> pd.DataFrame:
        there = [v is not None for v in values]
        sizes, made = encode([v for v in values if v is not None])
        rows = iter([(b, str(n), f"{len(b) * 8 / n:.2f}" if n else "nan") for n, b in zip(sizes, made)])
        return pd.DataFrame([next(rows) if ok else (None, None, None) for ok in there], columns=["bytes", "size", "average"])

    p = pack(values)
    pairs = [x for k, v in fixed.items() for x in (F.lit(k), F.lit(v))] + [F.lit("size"), p["size"]] + ([F.lit("avg_bits"), p["average"]] if averaged else [])
    return F.struct(p["bytes"].alias("bytes"), F.when(p["size"].isNotNull(), F.create_map(*pairs)).alias("params"))


def _huffman_stream(points, values: Column, code: Code) -> Column:
    def encode(values):
        arrays = [points(v) for v in values]
        return [len(a) for a in arrays], huffman_encode_all(arrays, code)

    return _stream(encode, values, {"packer": "huffman_packer", "format_version": FORMAT_VERSION, "codeword_map_name": code.name, "code_diff": str(int(code.diff))}, True)


def pack_huffman(spark, values: Column, code: Code) -> Column:
    """A stream from an array column; a null array gives a null stream's fields."""
    ship_package(spark)
    return _huffman_stream(lambda v: np.asarray(v, np.int64), values, code)


def pack_characters(spark, text: Column, code: Code, less: int = 0, most: int | None = None, mask: int = -1) -> Column:
    """A stream of the characters of a text: code points ``less`` a constant, at most ``most``, masked."""
    ship_package(spark)

    def points(t):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) - less
        return (points if most is None else np.minimum(points, most)) & mask

    return _huffman_stream(points, text, code)


def unpack_characters(spark, stream: Column, code: Code, more: int = 0) -> Column:
    """The text of ``pack_characters``, without what the mask took."""
    ship_package(spark)

    @F.pandas_udf("string")
    def unpack(data: pd.Series, params: pd.Series) -> pd.Series:
        text = lambda d, p: (np.array(huffman_decode(d, dict(p), code), np.int64) + more).astype("<u4").tobytes().decode("utf-32-le")
        return pd.Series([None if d is None else text(d, p) for d, p in zip(data, params)])

    return unpack(stream["bytes"], stream["params"])


def unpack_huffman(spark, stream: Column, code: Code) -> Column:
    """The array of a stream; a damaged stream is an error."""
    ship_package(spark)

    @F.pandas_udf("array<bigint>")
    def unpack(data: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else huffman_decode(d, dict(p), code) for d, p in zip(data, params)])

    return unpack(stream["bytes"], stream["params"])


def pack_bits(spark, values: Column, num_bits: int, width: int = 2) -> Column:
    ship_package(spark)

    def encode(values):
        return [len(v) for v in values], bit_encode_all([np.asarray(v) for v in values], num_bits, width)

    return _stream(encode, values, {"packer": "bit_packer", "num_bits": str(min(num_bits, 8 * width))}, False)


def unpack_bits(spark, stream: Column) -> Column:
    ship_package(spark)

    @F.pandas_udf("array<bigint>")
    def unpack(data: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else bit_decode(d, dict(p)) for d, p in zip(data, params)])

    return unpack(stream["bytes"], stream["params"])


def stream_bits(stream: Column) -> Column:
    return F.octet_length(stream["bytes"]).cast("bigint") * 8
