"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Plan: two maps over the documents.  The first counts, over the whole corpus, the words that are no
entry of the vocabulary; only (word, count) is shuffled, summed in every task before.  The driver
takes the most frequent of them - a fixed number, whatever the corpus - and compiles them and the
vocabulary with their ids into a minimal acyclic transducer: suffixes are shared, and every arc
carries the number of words sorted before it, so the sum along a path is the word's number and a table
gives its ids.  The automaton is one array file that the executors fetch once and map into memory.
The second map cuts batches into words and walks them through it all at once: step j moves every word
still alive by its j-th byte.  Words that fall off are merged exactly, pair by lowest rank, and
remembered; no id depends on what the lexicon holds.

Defined results: null and empty texts give an empty array; texts that look like special tokens are
plain text; one row for each input row, whatever repeats; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir, spread, table
from .textarrays import LETTER, OTHER, SPACE, blocks, classes, codepoints

#: Where the public vocabulary is found; any rank file of a byte-level BPE with the same word pattern does.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_REMEMBERED = 400_000
#: Most frequent words taken into the lexicon besides the vocabulary, and the longest (in bytes) that are counted.
FREQUENT, LONGEST = 40_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte pair encoding of one word: always the leftmost pair of the lowest rank; n log n."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    ends = list(range(1, n + 1))  # end of the part that starts at i
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : ends[j]])) is not None:
            heap.append((r, i, ends[i], ends[j])) if building else heapq.heappush(heap, (r, i, ends[i], ends[j]))

    building = True
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    building = False
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if not alive[i] or ends[i] != mid or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


class Transducer:
    """A minimal acyclic transducer over bytes in a double array.

    Built from sorted words by the incremental method of Daciuk et al.: when the next word leaves
    the last one's path, the finished tail is replaced by an equal state if there is one.
    """

    def __init__(self, words: list[bytes]):
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        free: list[int] = []
        path: list[tuple[int, int]] = []  # (state, byte) of the last word's arcs

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                state, byte = path.pop()
                child = arcs[state][byte]
                key = (final[child], tuple(arcs[child].items()))
                if (same := register.get(key)) is not None:
                    arcs[state][byte] = same
                    free.append(child)
                else:
                    register[key] = child

        last = b""
        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            settle(common)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                if free:
                    new = free.pop()
                    arcs[new], final[new] = {}, False
                else:
                    new = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[state][byte] = new
                path.append((state, byte))
                state = new
            final[state] = True
            last = word
        settle(0)
        counts: dict[int, int] = {}

        def count(state: int) -> int:  # words accepted from here; depth is bounded by the longest word
            if state not in counts:
                counts[state] = int(final[state]) + sum(count(s) for s in arcs[state].values())
            return counts[state]

        count(0)
        order = sorted(counts, key=lambda s: -len(arcs[s]))
        base: dict[int, int] = {}
        # First fit, the widest states first; states of one width go on where the last one fitted.
        used, low, hint, width = bytearray(1 << 12), 0, 0, 0
        for state in order:
            labels = sorted(arcs[state])
            if not labels:
                base[state] = 0
                continue
            first, rest = labels[0], [x - labels[0] for x in labels[1:]]
            if len(labels) != width:
                hint, width = low, len(labels)
            at = max(hint, first)
            while True:
                found = used.find(0, at)
                if found < 0 or found + 256 >= len(used):
                    used.extend(bytes(len(used)))
                    continue
                at = found
                if not any(used[at + x] for x in rest):
                    break
                at += 1
            base[state] = at - first
            for x in labels:
                used[base[state] + x] = 1
            low = used.find(0, low)
            hint = max(at, low)
        size = used.rfind(1) + 257
        number = {s: i for i, s in enumerate([0, *(s for s in order if s != 0)])}
        self.check = np.full(size, -1, np.int32)
        self.target = np.zeros(size, np.int32)
        self.skip = np.zeros(size, np.int32)
        self.base = np.zeros(len(number), np.int32)
        self.final = np.zeros(len(number), np.int32)
        for state, no in number.items():
            self.base[no], self.final[no] = base[state], final[state]
            before = int(final[state])
            for byte in sorted(arcs[state]):
                at = base[state] + byte
                self.check[at], self.target[at], self.skip[at] = no, number[arcs[state][byte]], before
                before += counts[arcs[state][byte]]


def pack(ranks: dict[bytes, int], extra: list[bytes] = (), known: dict[bytes, list[int]] | None = None) -> np.ndarray:
    """The lexicon as one array: automaton, id lists by word number, and the vocabulary itself.

    ``known`` may hold ids of words that were merged before.
    """
    words = sorted({*ranks, *extra})
    auto = Transducer(words)
    ids = [known[w] if known and w in known else merge(w, ranks) for w in words]
    vocab = sorted(ranks, key=ranks.get)
    blob = np.frombuffer(b"".join(vocab) + b"\0" * (-sum(map(len, vocab)) % 4), np.int32)
    parts = [auto.base, auto.final, auto.check, auto.target, auto.skip, np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32), np.array([x for i in ids for x in i], np.int32), np.array([ranks[w] for w in vocab], np.int32), np.array([len(w) for w in vocab], np.int32), blob]
    return np.concatenate([np.array([len(p) for p in parts], np.int32), *parts])


class Lexicon:
    """The packed lexicon, read in place."""

    PARTS = 10

    def __init__(self, packed: np.ndarray):
        sizes = np.array(packed[: self.PARTS], np.int64)
        ends = np.cumsum(sizes) + self.PARTS
        self.base, self.final, self.check, self.target, self.skip, self.offsets, self.ids, rank, length, blob = (packed[e - s : e] for s, e in zip(sizes, ends))
        raw, at, self.ranks = blob.tobytes(), 0, {}
        for r, n in zip(rank.tolist(), length.tolist()):
            self.ranks[raw[at : at + n]] = r
            at += n
        self.memo: dict[bytes, list[int]] = {}

    def numbers(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each word in the lexicon, or -1."""
        out = np.full(len(start), -1, np.int32)
        live = np.flatnonzero(length > 0)
        state = np.zeros(len(live), np.int32)
        number = np.zeros(len(live), np.int32)
        at, left = start[live], length[live]
        while len(live):
            slot = self.base[state] + data[at]
            ok = np.flatnonzero(self.check[slot] == state)
            slot = slot[ok]
            state, number = self.target[slot], number[ok] + self.skip[slot]
            live, at, left = live[ok], at[ok] + 1, left[ok] - 1
            done = left == 0
            if done.any():
                over = np.flatnonzero(done)
                hit = over[self.final[state[over]] == 1]
                out[live[hit]] = number[hit]
                go = np.flatnonzero(~done)
                state, number, live, at, left = state[go], number[go], live[go], at[go], left[go]
        return out

    def unseen(self, word: bytes) -> list[int]:
        got = self.memo.get(word)
        if got is None:
            got = merge(word, self.ranks)
            if len(self.memo) >= _REMEMBERED:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = got
        return got


@cache
def _lexicon(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


def cut_words(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words of the pattern
    ``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    n = len(flat)
    kind = classes()[flat]
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head[n] = True
    run = head.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(run[:n] & (kind != SPACE) & ~head[:n])  # runs after something in the same text
    spaced = first[kind[first - 1] == SPACE]
    blank = flat[spaced - 1] == 32
    joined = spaced[blank]
    starts = run.copy()
    starts[joined] = False
    starts[spaced - 1] = True
    # An apostrophe alone between something other than a blank and the letters of a contraction.
    quote = np.flatnonzero((flat[:-1] == 39) & run[: n - 1] & run[1:n] & (kind[1:] == LETTER) & ~head[1:n]) if n > 1 else np.zeros(0, np.int64)
    quote = quote[starts[quote]]
    one = flat[quote + 1]
    beyond = np.minimum(quote + 2, n - 1)
    two = np.where(head[np.minimum(quote + 2, n)], 0, flat[beyond])
    short = np.isin(one, [ord(c) for c in "sdmt"])
    long = ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
    for which, size in ((short, 1), (long & ~short, 2)):
        q = quote[which]
        starts[q + 1] = False
        starts[q + 1 + size] = True
    return np.flatnonzero(starts[:n])


def _split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, where words start and end in them, and where the n+1 texts do."""
    flat, offsets = codepoints(texts)
    # An empty text shares its offset with the next one and starts no word.
    start = cut_words(flat, offsets[np.r_[True, offsets[1:] > offsets[:-1]]] if offsets[-1] == len(flat) else offsets)
    raw = "".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    if len(data) == len(flat):
        byte, doc_at = start, offsets
    else:
        wide = np.r_[0, np.cumsum(1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF).astype(np.int64))]
        byte, doc_at = wide[start], wide[offsets]
    return raw, byte, np.r_[byte[1:], len(data)], doc_at


def count_unseen(texts: list[str], lexicon: Lexicon, into: Counter) -> None:
    """Add the words of ``texts`` that the lexicon lacks."""
    if not any(texts):
        return
    raw, byte, end, _ = _split(texts)
    missing = np.flatnonzero((lexicon.numbers(np.frombuffer(raw, np.uint8), byte, end - byte) < 0) & (end - byte <= LONGEST))
    into.update([raw[a:b] for a, b in zip(byte[missing].tolist(), end[missing].tolist())])


def encode(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and the n+1 offsets of the texts in them."""
    if not any(texts):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    raw, byte, end, doc_at = _split(texts)
    number = lexicon.numbers(np.frombuffer(raw, np.uint8), byte, end - byte)
    seen = number >= 0
    size = np.zeros(len(number), np.int64)
    at = lexicon.offsets[number[seen]]
    size[seen] = lexicon.offsets[number[seen] + 1] - at
    merged = []
    for k in np.flatnonzero(~seen).tolist():
        ids = lexicon.unseen(raw[byte[k] : end[k]])
        size[k] = len(ids)
        merged.append(ids)
    place = np.r_[0, np.cumsum(size)]
    out = np.empty(place[-1], np.int32)
    most = int(size[seen].max(initial=0))
    for j in range(most):
        has = size[seen] > j
        out[place[:-1][seen][has] + j] = lexicon.ids[at[has] + j]
    if merged:
        inside = np.repeat(~seen, size)
        out[inside] = np.fromiter((x for ids in merged for x in ids), np.int32)
    return out, place[np.searchsorted(byte, doc_at)]


@cache
def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, list[int]]]:
    """Ranks of a vocabulary, and the ids of its own entries as words."""
    ranks = read_ranks(path)
    return ranks, {w: merge(w, ranks) for w in ranks}


@lru_cache(4)
def _packed(vocabulary: str, extra: tuple[bytes, ...]) -> bytes:
    ranks, known = _vocabulary(vocabulary)
    buffer = io.BytesIO()
    np.save(buffer, pack(ranks, extra, known))
    return buffer.getvalue()


def _publish(spark, vocabulary: str, extra: tuple[bytes, ...] = ()) -> str:
    """Write the packed lexicon to the shared folder and let the executors fetch it; returns its name."""
    data = _packed(vocabulary, extra)
    name = f"strataquery-lexicon-{hashlib.sha256(data).hexdigest()[:16]}.npy"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        stream = fs.create(target, True)
        stream.write(data)
        stream.close()
    spark.sparkContext.addFile(path)
    return name


def frequent_words(docs: DataFrame, text: str, vocabulary: str = VOCABULARY, most: int = FREQUENT) -> tuple[bytes, ...]:
    """The ``most`` frequent words of the whole corpus that are no entry of the vocabulary, sorted."""
    name = _publish(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        lexicon, held = _lexicon(name), Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for _, texts in blocks(batch, 0):
                count_unseen(texts, lexicon, held)
                if len(held) > _REMEMBERED:
                    yield out()
        yield out()

    counted = spread(docs.select(F.col(text).cast("string").alias("t"))).mapInArrow(run, "word binary, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(most)
    # At most ``most`` words of LONGEST bytes come to the driver: a few MB at any size.
    return tuple(sorted(bytes(r[0]) for r in top.select("word").collect()))


def token_ids(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, most: int = FREQUENT) -> DataFrame:
    """``key`` and ``ids`` of every row of ``docs``."""
    name = _publish(docs.sparkSession, vocabulary, frequent_words(docs, text, vocabulary, most) if most else ())

    def run(batches: Iterator[pa.RecordBatch]):
        lexicon = _lexicon(name)
        for batch in batches:
            for rows, texts in blocks(batch):
                flat, offsets = encode(texts, lexicon)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), ids], names=["key", "ids"])

    return spread(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")
