"""Evaluation items that stand in training documents, whole or in part.

Plan: windows of consecutive words of every item and document - of a fixed size, or as long as the item -
are embedded by the CGK random walk: the walk reads the window with a pointer that a hash of (step, word) moves on or not,
so windows a few edits apart soon run in step again and edit distance becomes Hamming distance.  A
repetition samples some steps of the walk; windows that agree on them are candidates, and all
candidates are verified by exact edit distance over words.  Equal windows walk alike, so at
distance 0 one repetition finds every match; with edits allowed the recall grows with the
repetitions.  Both windows have the same number of words, so an inserted or a lost word counts twice
unless it is at an end.

Items are a stated query set: they go to the executors in blocks of bounded size, each against all
documents, so any number of items works and no corpus row is ever shuffled.  A block is a table of
the items' sampled prefixes; a document's windows are walked all together and a window is dropped at
the first sampled step where no item agrees, so most windows cost two or three steps.

Defined results: null, empty and short texts match nothing; a repeated item or document matches
like the first; one row for each pair; no items give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread, table
from .textarrays import blocks, mix, words

#: Words of a window, steps sampled by a repetition, and most code points of items in a block.
WINDOW, SAMPLES, BLOCK_CHARS = 13, 10, 4_000_000
#: Repetitions with edits, and how many words of a window there are to one edit.
REPEATS, WORDS_AN_EDIT = 24, 10
#: Most bytes of a block's bitmaps, whatever the repetitions.
BITMAP_BYTES = 64_000_000
_PAD = np.uint64(0x5BD1E9955BD1E995)


@dataclass
class _Prefixes:
    """What one repetition has of a block of items."""

    seed: int
    steps: np.ndarray  # sampled steps of the walk, ascending
    maps: list[np.ndarray]  # for each sampled step a bitmap of the prefixes items have
    keys: np.ndarray  # full samples, ascending
    owner: np.ndarray  # the item window of each


def _moves(step: int, seed: int, symbol: np.ndarray) -> np.ndarray:
    return (mix(symbol + np.uint64((seed * 1_000_003 + step * 7919 + 17) & 0xFFFFFFFF)) >> np.uint64(63)).astype(np.int64)


def _walk(hashes: np.ndarray, start: np.ndarray, size: int, seed: int, steps: np.ndarray, maps: list[np.ndarray] | None):
    """Walk windows; returns those still alive and their sample, and the prefixes on the way."""
    ptr, key = start.astype(np.int64), np.full(len(start), seed, np.uint64)
    live = np.arange(len(start))
    prefixes = []
    sampled = {int(s): k for k, s in enumerate(steps)}
    padded = np.r_[hashes, np.full(size + 1, _PAD)]
    for step in range(int(steps[-1]) + 1):
        symbol = padded[ptr]
        over = ptr >= start[live] + size
        if over.any():
            symbol = np.where(over, _PAD, symbol)
        if (k := sampled.get(step)) is not None:
            key = mix(key ^ (symbol + np.uint64(k)))
            if maps is None:
                prefixes.append(key)
            else:
                spot = (key & np.uint64(len(maps[k]) * 8 - 1)).astype(np.int64)
                stay = np.flatnonzero((maps[k][spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                live, ptr, key, symbol = live[stay], ptr[stay], key[stay], symbol[stay]
                if not len(live):
                    break
        ptr = ptr + _moves(step, seed, symbol)
    return live, key, prefixes


def _windows(doc: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that don't leave their text."""
    if len(doc) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])


def _block(ids: list[int], texts: list[str], size: int, repeats: int, samples: int, reach: int) -> dict:
    hashes, doc, start, end = words(texts)
    at = _windows(doc, size)
    own = [texts[d][s:e].lower() for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist())]
    tables = []
    # Bitmaps as wide as keeps chance hits rare, within their bound.
    bits = min(max((len(at) * (128 if reach else 512)).bit_length(), 10), 24, (BITMAP_BYTES * 8 // (samples * repeats)).bit_length() - 1)
    for seed in range(repeats):
        rng = np.random.default_rng(seed)
        # Without edits the first steps tell most.  With edits any do, drawn anew each time, the first too, or an
        # edit of the first word would be missed every time; a walk leaves its window after some 2 * size steps.
        steps = np.sort(rng.choice(np.arange(2 * size), samples, replace=False)) if reach else np.unique(np.r_[0, 2, 3, np.linspace(5, 3 * size - 1, samples - 3).astype(int)])
        _, key, prefixes = _walk(hashes, at, size, seed, steps, None)
        maps = []
        for p in prefixes:
            bitmap = np.zeros(1 << (bits - 3), np.uint8)
            spot = np.unique((p & np.uint64((1 << bits) - 1)).astype(np.int64))
            np.bitwise_or.at(bitmap, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
            maps.append(bitmap)
        order = np.argsort(key, kind="stable")
        tables.append(_Prefixes(seed, steps, maps, key[order], order))
    return {"ids": np.array(ids, np.int64), "doc": doc, "at": at, "words": own, "tables": tables, "size": size, "reach": reach}


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of word lists, or ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if not most:
        return 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _match(texts: list[str], items: list[dict]) -> set[tuple[int, int]]:
    """(text, item id) of what the blocks ``items`` find in texts."""
    hashes, doc, start, end = words(texts)
    found: set[tuple[int, int]] = set()
    for block in items:
        size, reach = block["size"], block["reach"]
        at = _windows(doc, size)
        spelled: dict[int, list[str]] = {}
        for t in block["tables"]:
            if not len(t.keys) or not len(at):
                continue
            live, key, _ = _walk(hashes, at, size, t.seed, t.steps, t.maps)
            lo, hi = np.searchsorted(t.keys, key, "left"), np.searchsorted(t.keys, key, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                w = int(at[live[k]])
                d = int(doc[w])
                for o in t.owner[lo[k] : hi[k]].tolist():
                    first = int(block["at"][o])
                    pair = (d, int(block["ids"][block["doc"][first]]))
                    if pair in found:
                        continue
                    if w not in spelled:
                        spelled[w] = [texts[d][start[i] : end[i]].lower() for i in range(w, w + size)]
                    if edit_distance(spelled[w], block["words"][first : first + size], reach) <= reach:
                        found.add(pair)
    return found


def size_class(count: int) -> int:
    """Words of the windows for an item of ``count`` words: the next lower step of a ladder that rises by a quarter."""
    step = 1
    while (up := max(step + 1, step * 5 // 4)) <= count:
        step = up
    return step


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int | None = WINDOW, reach: int | None = 0, repeats: int = 1, samples: int = SAMPLES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id`` of documents having ``size`` words within ``reach`` word edits of an item's.

    Without ``size`` windows are as long as the item, a step of a ladder below it (``size_class``); without
    ``reach`` one edit is allowed for every ``WORDS_AN_EDIT`` words of the window.  However many sizes
    there are, the documents are read once for each block of items.
    """
    spark = docs.sparkSession
    corpus = spread(docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")))
    out, held = None, []

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        # A block has at most ``block_chars`` code points (or one item), and its bitmaps a bound of their own.
        classes: dict[int, list[tuple[int, str]]] = {}
        if size is None:
            _, doc, _, _ = words([t for _, t in part])
            for n, item in zip(np.bincount(doc, minlength=len(part)).tolist(), part):
                if n:
                    classes.setdefault(size_class(n), []).append(item)
        else:
            classes[size] = part
        made = [_block([i for i, _ in own], [t for _, t in own], w, repeats, samples, w // WORDS_AN_EDIT if reach is None else reach) for w, own in sorted(classes.items())]
        shared = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for rows, own in blocks(batch):
                    pairs = sorted(_match(own, shared.value))
                    if pairs:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[[d for d, _ in pairs]])), pa.array([i for _, i in pairs], pa.int64())], names=["d", "i"])

        return corpus.mapInArrow(run, "d long, i long")

    query = items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).filter(F.col(item_text).isNotNull())
    chars, most = 0, max(1, block_chars // max(1, repeats // 4))
    for i, t in query.toLocalIterator():
        if held and chars + len(t) > most:
            part = scan(held)
            out = part if out is None else out.unionByName(part)
            held, chars = [], 0
        held.append((i, t))
        chars += len(t)
    if held or out is None:
        part = scan(held)
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("d").alias("doc_id"), F.col("i").alias("item_id"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_edits(spark, sf_dir: str) -> DataFrame:
    """Documents that hold an item, whole or nearly so: item-sized windows, one word in ten edited."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", size=None, reach=None, repeats=REPEATS)
