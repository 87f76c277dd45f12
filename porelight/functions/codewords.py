"""Prefix codes of the packed streams.

A code maps a symbol to a string of bits, of which the first is the lowest bit
in the stream; ``.`` is the escape. Codes are data: the small ones stand here,
the one for raw differences, with over 200 entries, comes from a file of
``symbol code`` lines (``load``) or is made from a distribution (``laplace``).
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

ESCAPE = "."
FORMAT_VERSION = "2"
MOST_BITS = 57

# They must equal those of existing files for those to be read.
ED_SKIP = {"0": "0", ".": "1"}
EV_REL_SKIP = {"0": "0", ".": "1"}
EV_MOVE = {"0": "0", "1": "10", "2": "110", ".": "111"}
FQ_BP = {"65": "00", "67": "01", "71": "10", "84": "110", ".": "111"}
FQ_QV = {
    "10": "10", "16": "00000", "17": "00001", "18": "00010", "19": "00011", "20": "00100", "21": "00101", "22": "00110", "23": "00111", "24": "01000", "25": "01001", "26": "01010", "27": "01011",
    "28": "01100", "29": "01101", "30": "01110", "31": "01111", ".": "110000", "0": "110001", "1": "110010", "2": "110011", "3": "110100", "4": "110101", "5": "110110", "6": "110111", "7": "111000",
    "8": "111001", "9": "111010", "11": "111011", "12": "111100", "13": "111101", "14": "111110", "15": "111111",
}
ED_LEN = {
    "8": "001", "7": "010", "6": "100", "5": "111", "12": "0001", "11": "1010", "10": "1100", "9": "1101", "16": "00001", "4": "01101", "15": "01110", "14": "10110", "13": "10111", "19": "000001",
    "18": "011001", "17": "011111", "22": "0110000", "21": "0111100", "20": "0111101", "25": "00000010", "24": "01100010", "23": "01100011", "28": "000000001", "27": "000000110", "26": "000000111",
    "31": "0000000000", "30": "0000000100", "29": "0000000111", "32": "00000001010", "34": "000000000100", "35": "000000000110", "33": "000000011011", "41": "0000000001011", "40": "0000000001110",
    "36": "0000000101100", "37": "0000000110100", "38": "00000000010101", "42": "00000000011110", "39": "00000001101011", "99": "000000000101000", "100": "000000000101001", "43": "000000000111110",
    "44": "000000000111111", "46": "000000010110100", "53": "000000010110101", ".": "0000000101101100", "1": "0000000101101101", "2": "0000000101101110", "3": "0000000101101111",
    "45": "0000000101110000", "47": "0000000101110001", "48": "0000000101110010", "49": "0000000101110011", "50": "0000000101110100", "51": "0000000101110101", "52": "0000000101110110",
    "54": "0000000101110111", "55": "0000000101111000", "56": "0000000101111001", "57": "0000000101111010", "58": "0000000101111011", "59": "0000000101111100", "60": "0000000101111101",
    "61": "0000000101111110", "62": "0000000101111111", "63": "0000000110000000", "64": "0000000110000001", "65": "0000000110000010", "66": "0000000110000011", "67": "0000000110000100",
    "68": "0000000110000101", "69": "0000000110000110", "70": "0000000110000111", "71": "0000000110001000", "72": "0000000110001001", "73": "0000000110001010", "74": "0000000110001011",
    "75": "0000000110001100", "76": "0000000110001101", "77": "0000000110001110", "78": "0000000110001111", "79": "0000000110010000", "80": "0000000110010001", "81": "0000000110010010",
    "82": "0000000110010011", "83": "0000000110010100", "84": "0000000110010101", "85": "0000000110010110", "86": "0000000110010111", "87": "0000000110011000", "88": "0000000110011001",
    "89": "0000000110011010", "90": "0000000110011011", "91": "0000000110011100", "92": "0000000110011101", "93": "0000000110011110", "94": "0000000110011111", "95": "0000000110101000",
    "96": "0000000110101001", "97": "0000000110101010", "98": "0000000110101011",
}


class Code:
    """A named prefix code for integers of ``width`` bytes, of differences if ``diff``."""

    def __init__(self, name: str, table: dict[str, str], width: int, diff: bool = False, signed: bool = True):
        self.name, self.width, self.diff, self.signed = name, width, diff, signed
        self.table = dict(table)
        if ESCAPE not in table:
            raise ValueError(f"code {name} has no escape")
        for code in table.values():
            if len(code) > MOST_BITS:
                raise ValueError(f"codeword {code} is longer than {MOST_BITS} bits")
        self.words = {int(s): (int(c[::-1], 2), len(c)) for s, c in table.items() if s != ESCAPE}
        self.escape = (int(table[ESCAPE][::-1], 2), len(table[ESCAPE]))
        codes = sorted(table.values())
        if any(b.startswith(a) for a, b in zip(codes, codes[1:])):
            raise ValueError(f"code {name} is not prefix-free")

    def __reduce__(self):
        return Code, (self.name, self.table, self.width, self.diff, self.signed)

    def rows(self) -> list[tuple[str, int | None, bool, str, int]]:
        """Rows of the ``codeword`` table."""
        return [(self.name, None if s == ESCAPE else int(s), s == ESCAPE, c, len(c)) for s, c in self.table.items()]


def train(counts: dict[int, int], low: int, high: int) -> list[tuple[str, str]]:
    """A code from a histogram of [low - 1, high], where low - 1 is the escape: (symbol, code) by length and code.

    One is added to every count. The two least (count, symbol) nodes are joined
    again and again, the first as branch 0; new nodes are numbered from high + 1.
    """
    heap = [(counts.get(v, 0) + 1, v) for v in range(low - 1, high + 1)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    new = high + 1
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[new] = (a, b)
        heapq.heappush(heap, (n + m, new))
        new += 1
    codes, todo = [], [(heap[0][1], "")]
    while todo:
        node, code = todo.pop()
        if node in children:
            todo += [(c, code + bit) for c, bit in zip(children[node], "01")]
        else:
            codes.append((ESCAPE if node == low - 1 else str(node), code))
    return sorted(codes, key=lambda x: (len(x[1]), x[1]))


def laplace(low: int = -100, high: int = 100, scale: float = 12.0, weight: int = 1 << 20) -> dict[str, str]:
    """A code for differences that fall off exponentially on both sides of 0."""
    counts = {v: int(weight * math.exp(-abs(v) / scale)) for v in range(low, high + 1)}
    counts[low - 1] = 2 * int(weight * math.exp(-high / scale) * scale)
    return dict(train(counts, low, high))


def load(lines) -> dict[str, str]:
    """A code from ``symbol code`` lines."""
    return {s: c for s, c in (line.split() for line in lines if line.strip())}


@lru_cache(8)
def _family(prefix: str, raw: tuple[tuple[str, str], ...] | None) -> dict[str, Code]:
    kinds = {"rw": (dict(raw) if raw else laplace(), 2, True, True), "ed_skip": (ED_SKIP, 8), "ed_len": (ED_LEN, 8), "fq_bp": (FQ_BP, 1), "fq_qv": (FQ_QV, 1, False, False), "ev_rel_skip": (EV_REL_SKIP, 8), "ev_move": (EV_MOVE, 1, False, False), "al_move": (EV_MOVE, 1)}
    return {k: Code(f"{prefix}_{'ev_move' if k == 'al_move' else k}_1", *v) for k, v in kinds.items()}


def coders(prefix: str = "porelight", raw: dict[str, str] | None = None) -> dict[str, Code]:
    """The codes by use. ``prefix`` begins the map names that streams carry, ``raw`` is the code of raw differences."""
    return _family(prefix, tuple(sorted(raw.items())) if raw else None)
