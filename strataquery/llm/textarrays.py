"""Texts of an Arrow batch as flat arrays of code points, words and hashes.

Python-level loops over characters or words would cost more than everything else, so the text
operators work on whole batches: one array of code points with the offset of each text, and tables
of 0x110000 entries for what a code point is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Most code points that a batch is worked on at once; a longer text is worked on alone.
BLOCK = 2_000_000


@cache
def _categories() -> np.ndarray:
    """The general category of every code point, as two letters."""
    return np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8).reshape(-1, 2)


@cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    out[_categories()[:, 0] == ord("L")] = LETTER
    out[_categories()[:, 0] == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@cache
def lowered() -> np.ndarray:
    """Lower case of every code point that has a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero((classes() == LETTER) | (classes() == NUMBER) | (_categories() == [ord("S"), ord("o")]).all(1)).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def blocks(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Row numbers and texts (null as '') of a batch, in blocks of bounded size."""
    rows, texts, held = [], [], 0
    for i, value in enumerate(batch.column(text).to_pylist()):
        value = value or ""
        if held and held + len(value) > BLOCK:
            yield np.array(rows), texts
            rows, texts, held = [], [], 0
        rows.append(i)
        texts.append(value)
        held += len(value)
    if rows:
        yield np.array(rows), texts


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points on end, and the n+1 offsets of the texts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(22, int(n).bit_length()))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hashes`` reads spans from them."""
    up, _ = powers(len(values))
    spread = mix(values.astype(np.uint64) + np.uint64(0x1B873593))
    return np.r_[np.uint64(0), np.cumsum(spread * up[: len(values)])]


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters and digits, hashed in lower case.

    Returns the hash, text number, start and end (in the text) of every word.
    """
    # What lower-cases to several code points or by context is lower-cased word by word.
    odd = [i for i, t in enumerate(texts) if not t.isascii() and ("İ" in t or "Σ" in t)]
    flat, offsets = codepoints(texts)
    kind = classes()[flat]
    inside = (kind == LETTER) | (kind == NUMBER)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(flat))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    prefix = prefix_hashes(lowered()[flat])
    hashes = span_hashes(prefix, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    for i in odd:
        lo, hi = np.searchsorted(start, offsets[i]), np.searchsorted(start, offsets[i + 1])
        own = [texts[i][start[k] - offsets[i] : end[k] - offsets[i]].lower() for k in range(lo, hi)]
        hashes[lo:hi] = hash_words(own)
    return hashes, doc, start - offsets[doc], end - offsets[doc]


def hash_words(own: list[str]) -> np.ndarray:
    """The hashes that ``words`` gives to these lower-cased words."""
    flat, offsets = codepoints(own)
    return span_hashes(prefix_hashes(flat), offsets[:-1], offsets[1:]) if own else np.zeros(0, np.uint64)
