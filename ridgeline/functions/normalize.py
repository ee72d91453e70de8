"""Text normalisation: ASCII lower case, transliteration to ASCII, folded punctuation and single spaces.

Codepoints map one to many; what has no mapping stays. Byte offsets of the normalised text map back to the original's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Targets of 64 codepoints each from the given one on; 0 stands for "as it is".
_PAGES = {
    0x00C0: "aaaaaaaceeeeiiiidnooooo0ouuuuy0saaaaaaaceeeeiiiidnooooo0ouuuuy0y",
    0x0100: "aaaaaaccccccccddddeeeeeeeeeegggggggghhhhiiiiiiiiii00jjkkklllllll",
    0x0140: "lllnnnnnnnnnoooooooorrrrrrssssssssttttttuuuuuuuuuuuuwwyyyzzzzzzs",
    0x0180: "b0bb000c0dd00000eff0g000iik0000noo00p0000000tttuu0yyzz0000000000",
    0x01C0: "0000000000000aaiioouuuuuuuuuu0aaaaggggkkoooo00j0g00nnaaaaooaa000",
    0x0200: "aaaaeeeeiiiioooorrrruuuusstt00h00z0000aa0000oo00000yy00000000000",
    0x0240: "0000000000000000000b0cdd00e00000g00hh0ii0000ll00m0n0o0000rrr0000",
    0x0380: "000000a0eei0o0yoiabgdeze0iklmn0op00styfx0o000000abgdeze0iklmn0o0",
    0x03C0: "prsstyfx0o000000b0f000000000000000000000000000000000000000000000",
    0x0400: "e000000000000000abvgde0ziyklmnoprstufh00000y0e00abvgde0ziyklmnop",
    0x0440: "rstufh00000y0e00e0g0000000000000000000000000000000yy000000000000",
    0x0480: "00000000000000000g0g0000000000000k0k0000000000000n0n000000000000",
    0x04C0: "0000000000000000aa000000aa00000000000000oo0000uu00000000hh000000",
    0x0500: "0000000000000000000000000000000000000000000000000abgdezeytzilxtk",
    0x0540: "hdgcmynsocpjrsvtrcwpkof0000000000abgdezeytzilxtkhdgcmynsocpjrsvt",
    0x1E00: "aabbbbbbccddddddddddeeeeeeeeeeffgghhhhhhhhhhiiiikkkkllllllllmmmm",
    0x1E40: "mmnnnnnnoooooooopppprrrrrrrrssssssssssttttttttuuuuuuuuuuvvvvwwww",
    0x1E80: "wwwwwwxxxxyyyyzzzzzzhtwya0000000aaaaaaaaaaaaaaeeeeeeeeeeiioooooo",
    0x1EC0: "oooooooooooouuuuuuuuuuuuuuyyyyyy00000000000000000000000000000000",
    0x2000: "           00000------00''''\"\"\"\"0000.0.00000  0000''''''0''00000",
}
_MANY = {"Ææ": "ae", "Ĳĳ": "ij", "Œœ": "oe", "Θθ": "th", "Ξξ": "ks", "ψ": "ps", "Жж": "zh", "Цц": "ts", "Чч": "ch", "ШшЩщ": "sh", "Юю": "yu", "Яя": "ya", "ª": "a", "²": "2", "³": "3", "µ": "u", "¹": "1", "º": "o", " ": " "}
_NOTHING = [0xAD, 0x42A, 0x42C, 0x44A, 0x44C, *range(0x300, 0x370), *range(0x1A80, 0x1B00), *range(0x1DC0, 0x1E00)]


def _table() -> dict[int, str]:
    t: dict[int, str] = {}
    for start, page in _PAGES.items():
        t |= {start + i: c for i, c in enumerate(page) if c != "0"}
    t |= {c: chr(c + 32) for c in range(65, 91)} | {c: " " for c in range(9, 14)}
    t |= {ord(c): out for group, out in _MANY.items() for c in group}
    t |= dict.fromkeys(_NOTHING, "")
    for c in range(0xFF01, 0xFF5F):
        t[c] = chr(c - 0xFEE0).lower()
    return t


TABLE = _table()
_CONTROL = {c: " " for c in [*range(32), 127]}


def fold(text: str) -> str:
    """Every codepoint's target, without touching spaces and control characters."""
    return text.translate(TABLE)


def normalize(text: str) -> str:
    """Folded, control characters as spaces, runs of spaces as one, none at the ends."""
    return " ".join(p for p in fold(text).translate(_CONTROL).split(" ") if p)


def fold_with_offsets(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Folded bytes, and for each of them the first byte and the end of its codepoint in the original's UTF-8."""
    out, start, end, at = [], [], [], 0
    for c in text:
        n = len(c.encode("utf-8", "surrogatepass"))
        b = TABLE.get(ord(c), c).encode("utf-8", "surrogatepass")
        out.append(b)
        start += [at] * len(b)
        end += [at + n] * len(b)
        at += n
    return b"".join(out), np.array(start, np.int64), np.array(end, np.int64)


@F.pandas_udf(T.StringType())
def _normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else normalize(t))


def normalized(text: Column) -> Column:
    """normalize() of a column."""
    return _normalize(text)
