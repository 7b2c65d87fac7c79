"""Long stretches of text that stand verbatim in other documents too.

Plan: compact windows.  A text's tokens are its overlapping grams, hashed; a window of ``least``
characters has a least gram, its anchor.  The windows with one anchor are neighbours, so they make a
compact window - a node of the Cartesian tree over the hashes that spans at least one window - and a
text of n characters has about 2n/least of them instead of n.  Equal windows have equal anchors at
equal offsets, so one hash misses nothing, and only compact windows whose anchor also stands in
another document go on.  Usually their whole contexts (all characters their windows touch) are equal
and everything in them is shared.  Where the contexts of an anchor differ - at the edges of shared
stretches - one representative of each distinct context is compared with the others window by
window.  All windows of an anchor hold it, so what they share is one interval from the first to
the last shared window.  Intervals of a document are merged at the end.

An anchor and its context are equal if both their 64-bit hashes are, which is as good as equal texts.

Scale: joins on an anchor, a context or a window salt the heavy ones, such as those of a licence text that
a third of all documents have.  The shuffled rows are anchors (some 50 bytes for 100 characters), then only those of shared
anchors.  Texts are read again only for edge contexts, behind a bitmap of fixed size.  An anchor with
more than ``hot`` distinct contexts is not compared in one task: its windows become rows that are
grouped by content with partial aggregation.  Copies never make pairs.

Defined results: no normalising; null and short texts share nothing; a stretch repeated only within
its own document isn't shared; rows of one doc_id are one document; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.intervals import merge_runs
from ..operators.skew import replicated, salted
from ..session import Scratch, spread, table
from .textarrays import BLOCK, blocks, codepoints, mix, prefix_hashes, span_hashes

#: Characters of a shared stretch and of a gram, and the contexts of an anchor that one task compares.
LEAST, GRAM, HOT = 300, 80, 20_000
#: Most bits of the bitmap of documents whose texts are read again: half a million words at any size.
_BITMAP = 1 << 25


def compact_windows(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, start, further windows, anchor offset and context hash of every compact window."""
    flat, offsets = codepoints(texts)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(flat) < least:
        return none
    prefix = prefix_hashes(flat)
    at = np.arange(len(flat) - gram + 1)
    hashes = span_hashes(prefix, at, at + gram)
    bits = np.uint64(max(24, int(len(flat)).bit_length()))
    width = least - gram + 1
    # The leftmost least hash of every window: hash above, place below, minimum by doubling.
    low = (hashes >> bits << bits) | at.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    start = np.flatnonzero(doc[: len(anchor)] == doc[least - 1 : least - 1 + len(anchor)])
    if not len(start):
        return none
    anchor, own = anchor[start], doc[start]
    opens = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
    first, last, anchor, own = start[opens], start[np.r_[opens[1:], len(start)] - 1], anchor[opens], own[opens]
    context = mix(span_hashes(prefix, first, last + least) ^ mix((anchor - first).astype(np.uint64)))
    return hashes[anchor], own, first - offsets[own], last - first, anchor - first, context


def _windows(texts: list[str], count: np.ndarray, offset: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context number, anchor offset and hash of every window of edge contexts."""
    flat, offsets = codepoints(texts)
    prefix = prefix_hashes(flat)
    each = count + 1
    who = np.repeat(np.arange(len(texts)), each)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
    at = offsets[who] + nth
    return who, offset[who] - nth, span_hashes(prefix, at, at + least)


def _compare(table_: pa.Table, least: int) -> pa.RecordBatch | None:
    """First and last shared window of the edge contexts of whole anchors."""
    h, x = table_["h"].to_numpy(), table_["x"].to_numpy()
    who, offset, window = _windows(table_["t"].to_pylist(), table_["n"].to_numpy(), table_["off"].to_numpy(), least)
    key = mix(window ^ mix(h.view(np.uint64)[who] + offset.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    opens = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    d0, d1 = table_["d0"].to_numpy()[who][order], table_["d1"].to_numpy()[who][order]
    shared = np.minimum.reduceat(d0, opens) < np.maximum.reduceat(d1, opens)
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat(shared, np.diff(np.r_[opens, len(key)]))
    nth = table_["off"].to_numpy()[who] - offset
    lo, hi = np.full(len(h), 1 << 30, np.int64), np.full(len(h), -1, np.int64)
    np.minimum.at(lo, who[hit], nth[hit])
    np.maximum.at(hi, who[hit], nth[hit])
    any_ = np.flatnonzero(hi >= 0)
    return pa.RecordBatch.from_arrays([pa.array(h[any_]), pa.array(x[any_]), pa.array(lo[any_].astype(np.int32)), pa.array(hi[any_].astype(np.int32))], names=["h", "x", "lo", "hi"]) if len(any_) else None


def _met(rows: DataFrame, side: DataFrame, key: str, spread_: str, total: int, counts: str) -> DataFrame:
    """``rows`` joined with ``side``, whose key is unique and counted in ``counts``; heavy keys are salted."""
    left, heavy = salted(rows, key, spread_, total, side.select(key, F.col(counts).alias("n")))
    return left.join(replicated(side, key, heavy), [key, "_salt"]).drop("_salt")


def shared_spans(docs: DataFrame, doc_id: str, text: str, scratch: Scratch, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, span_start, span_end`` of the maximal shared runs."""
    corpus = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))

    def anchors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, texts in blocks(batch):
                h, own, first, more, offset, x = compact_windows(texts, least, gram)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[rows][own].astype(np.int64)), pa.array(x.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(offset.astype(np.int32))], names=["h", "d", "x", "c", "n", "off"])

    found = scratch.save(spread(corpus).mapInArrow(anchors, "h long, d long, x long, c int, n int, off int"), "anchors")
    both = found.groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")).filter("d0 < d1").select("h", (F.col("x0") != F.col("x1")).alias("mixed"), F.col("n").alias("anchors"))
    both = scratch.save(both, "both")
    shared = scratch.save(_met(found, both, "h", "d", found.count(), "anchors").drop("anchors"), "shared")
    scratch.drop("anchors")
    whole = shared.filter("not mixed").select("d", F.col("c").alias("s"), (F.col("c") + F.col("n") + least).alias("e"))

    edge = shared.filter("mixed")
    contexts = edge.groupBy("h", "x").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min(F.struct("d", "c", "n", "off")).alias("r"), F.count("*").alias("copies")).select("h", "x", "d0", "d1", F.col("r.d").alias("d"), F.col("r.c").alias("c"), F.col("r.n").alias("n"), F.col("r.off").alias("off"), "copies")
    contexts = scratch.save(contexts, "contexts")
    # Sixteen bits for every document to read again, within the bound of the bitmap.
    bits = min(max(64, 1 << (16 * contexts.select("d").distinct().count()).bit_length()), _BITMAP)
    bit = F.pmod(F.xxhash64("d"), F.lit(bits))
    marks = contexts.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("bits"))
    # At most _BITMAP/64 rows of 16 bytes: the bound is the bitmap's size.
    readable = corpus.withColumn("b", bit).withColumn("word", F.floor(F.col("b") / 64)).join(F.broadcast(marks), "word").filter(F.expr("shiftrightunsigned(bits, int(b % 64)) & 1 = 1")).select("d", "t")
    crowd = contexts.groupBy("h").agg(F.count("*").alias("many"))
    crowded = _met(contexts, crowd, "h", "x", contexts.count(), "many")
    read = crowded.join(readable, "d").select("h", "x", "d0", "d1", "n", "off", (F.col("many") > hot).alias("is_hot"), F.expr(f"substring(t, c + 1, n + {least})").alias("t"))
    read = scratch.save(read, "texts")

    def compare(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        chars = 0

        def whole_anchors(last: bool):
            nonlocal held, chars
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            cut = len(h) if last else int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
            held = t.slice(cut).to_batches() if cut < len(h) else []
            chars = 0
            return t.slice(0, cut) if cut else None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                chars += batch.num_rows * least
            if chars > BLOCK and (part := whole_anchors(False)) is not None and (out := _compare(part, least)) is not None:
                yield out
        if held and (part := whole_anchors(True)) is not None and (out := _compare(part, least)) is not None:
            yield out

    def explode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            t = pa.Table.from_batches([b])
            who, offset, window = _windows(t["t"].to_pylist(), t["n"].to_numpy(), t["off"].to_numpy(), least)
            take = lambda c: t[c].combine_chunks().take(pa.array(who))
            nth = (t["off"].to_numpy()[who] - offset).astype(np.int32)
            yield pa.RecordBatch.from_arrays([take("h"), take("x"), take("d0"), take("d1"), pa.array(offset.astype(np.int32)), pa.array(window.view(np.int64)), pa.array(nth)], names=["h", "x", "d0", "d1", "a", "w", "k"])

    cool = read.filter("not is_hot").drop("is_hot").repartition("h").sortWithinPartitions("h").mapInArrow(compare, "h long, x long, lo int, hi int")
    wide = read.filter("is_hot").drop("is_hot").mapInArrow(explode, "h long, x long, d0 long, d1 long, a int, w long, k int")
    wide = scratch.save(wide.withColumn("haw", F.struct("h", "a", "w")), "wide")
    twice = wide.groupBy("haw").agg(F.min("d0").alias("_d0"), F.max("d1").alias("_d1"), F.count("*").alias("times")).filter("_d0 < _d1").select("haw", "times")
    warm = _met(wide, twice, "haw", "x", wide.count(), "times").groupBy("h", "x").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    found_in = scratch.save(cool.unionByName(warm), "found").join(contexts.select("h", "x", "copies"), ["h", "x"]).select(F.struct("h", "x").alias("hx"), "lo", "hi", "copies")
    part = _met(edge.withColumn("hx", F.struct("h", "x")), found_in, "hx", "d", edge.count(), "copies").select("d", (F.col("c") + F.col("lo")).alias("s"), (F.col("c") + F.col("hi") + least).alias("e"))

    def merge(batches: Iterator[pa.RecordBatch]):
        # Rows come in order of document and start, so only the run that is open goes on to the next batch.
        open_ = [np.zeros(0, np.int64)] * 3
        row = lambda d, s, e: pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "span_start", "span_end"])
        for b in batches:
            if b.num_rows:
                cols = [np.r_[o, b.column(i).to_numpy().astype(np.int64)] for i, o in enumerate(open_)]
                done = merge_runs(*cols)
                open_ = [c[-1:] for c in done]
                yield row(*[c[:-1] for c in done])
        if len(open_[0]):
            yield row(*open_)

    return whole.unionByName(part).repartition("d").sortWithinPartitions("d", "s").mapInArrow(merge, "doc_id long, span_start int, span_end int")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", Scratch(spark, "spans"))


def p10_shares(spark, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere, zero included."""
    docs = table(spark, sf_dir, "documents")
    spans = p10_found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("stretches"))
    size = F.coalesce(F.length("text"), F.lit(0))
    return docs.select("doc_id", size.cast("long").alias("chars")).join(spans, "doc_id", "left").select("doc_id", "chars", F.coalesce("stretches", F.lit(0)).alias("stretches"), F.coalesce("shared", F.lit(0)).alias("shared"), F.when(F.col("chars") > 0, F.round(F.coalesce("shared", F.lit(0)) / F.col("chars"), 6)).alias("share"))
