"""Continuous periods and gaps of overlapping, nested and gapped intervals.

Plan: the mergeable aggregate is a list of sorted disjoint intervals.

1. Leaves: every scan task folds its own rows into such lists, one for each key and cell - a
   fixed stretch of time that an interval belongs to by its start - in Arrow batches (what
   overlaps never leaves the task).
2. Inner nodes: the partial lists meet by (key, cell).  Lists are merged linearly.  A key that holds a third of
   all rows is spread over its cells; no task ever holds a whole key.
3. Root: all a cell needs of the cells before it is one number, the greatest end so far - the
   ``carry``, a running maximum over one row for each cell of a key.  It enters the merge of
   step 2 as a row of its own.  Starts up to the carry belong to a period begun earlier; each
   later start opens a period and closes the one before, which gives the gap between them.
   Only a cell's last period can reach beyond it: its end is found among one or two boundary
   rows for each cell.

Nothing is collected and no list of a whole key is ever built.  Defined results: rows with a null
or empty name, a null bound or a start after its end don't count; equal bounds make a period of
length zero; touching windows are one period; repeated rows change nothing; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import table

#: Width of a cell.  Cells only spread the work; results don't depend on it.
CELL_US = 7 * 86_400_000_000
_FLUSH_ROWS = 1_000_000
_LEAF = "a string, b string, cell long, lo long, hi long"
_NODE = "a string, b string, cell long, tag int, lo long, hi long"


def merge_runs(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge intervals into sorted disjoint lists, one for each code (touching ones join)."""
    if not len(code):
        return code, lo, hi
    order = np.lexsort((lo, code))
    code, lo, hi = code[order], lo[order], hi[order]
    first = np.r_[True, code[1:] != code[:-1]]
    # Running maximum of the ends within each code: offset by rank, so one accumulate serves all.
    ranks = np.unique(hi, return_inverse=True)[1].astype(np.int64)
    span = np.int64(len(hi) + 1)
    group = np.cumsum(first) - 1
    reach_rank = np.maximum.accumulate(ranks + group * span) - group * span
    values = np.sort(np.unique(hi))
    reach = values[reach_rank]
    opens = first.copy()
    opens[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    ends = np.r_[at[1:], len(lo)] - 1
    return code[at], lo[at], reach[ends]


def _encode(*cols: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """A dense code for each distinct tuple, and the first row of every code."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        d = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        d = d if pa.types.is_integer(d.type) else d.dictionary_encode().indices
        part = np.unique(d.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        code = code * (int(part.max(initial=0)) + 1) + part
    first, code = np.unique(code, return_index=True, return_inverse=True)[1:]
    return code.astype(np.int64), [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).take(pa.array(first)) for c in cols]


def _leaf(batches):
    held: list[pa.RecordBatch] = []
    rows = 0

    def fold(parts):
        t = pa.Table.from_batches(parts)
        code, keys = _encode(t["a"], t["b"], t["cell"])
        c, lo, hi = merge_runs(code, t["lo"].to_numpy(), t["hi"].to_numpy())
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(c)) for k in keys), pa.array(lo), pa.array(hi)], names=["a", "b", "cell", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= _FLUSH_ROWS:
            held = [fold(held)]
            rows = 0
            if held[0].num_rows > _FLUSH_ROWS // 2:  # lists that don't shrink go on to the next node
                yield from held
                held = []
    if held:
        yield fold(held)


def _whole_cells(batches):
    """Rows that come in order of (key, cell) as tables of whole cells, some ``_FLUSH_ROWS`` at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= _FLUSH_ROWS:
            t = pa.Table.from_batches(held)
            same = [pc.equal(t[c], t[c][t.num_rows - 1]) for c in ("a", "b", "cell")]
            cut = t.num_rows - pc.sum(pc.and_(pc.and_(same[0], same[1]), same[2])).as_py()
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _node(batches):
    """Merge the lists of each (key, cell) that this task got, with the carry (tag 1) of the cell."""
    for t in _whole_cells(batches):
        yield from _merged(t)


def _merged(t: pa.Table):
    code, (a, b, cell) = _encode(t["a"], t["b"], t["cell"])
    tag, lo, hi = t["tag"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()
    carry = np.full(len(a), np.iinfo(np.int64).min)
    is_carry = tag == 1
    carry[code[is_carry]] = hi[is_carry]
    c, lo, hi = merge_runs(code[~is_carry], lo[~is_carry], hi[~is_carry])
    old = lo <= carry[c]
    reach = carry.copy()
    np.maximum.at(reach, c[old], hi[old])
    c, lo, hi = c[~old], lo[~old], hi[~old]
    if not len(c):
        return
    first = np.r_[True, c[1:] != c[:-1]]
    last = np.r_[first[1:], True]
    before = np.r_[0, hi[:-1]]
    before[first] = reach[c[first]]
    known = before != np.iinfo(np.int64).min
    # kind 0: gap, 1: closed period, 2: open period (lo its start), 3: the end of an earlier period
    kinds = [np.flatnonzero(known & (before < lo)), np.flatnonzero(~last), np.flatnonzero(last), np.flatnonzero(first & known)]
    los = [before[kinds[0]], lo[kinds[1]], lo[kinds[2]], before[kinds[3]]]
    his = [lo[kinds[0]], hi[kinds[1]], hi[kinds[2]], before[kinds[3]]]
    at = np.concatenate(kinds)
    idx = pa.array(c[at])
    kind = np.concatenate([np.full(len(k), i, np.int32) for i, k in enumerate(kinds)])
    yield pa.RecordBatch.from_arrays([a.take(idx), b.take(idx), cell.take(idx), pa.array(kind), pa.array(np.concatenate(los)), pa.array(np.concatenate(his))], names=["a", "b", "cell", "tag", "lo", "hi"])


def periods_and_gaps(rows: DataFrame, cell_us: int = CELL_US) -> DataFrame:
    """Periods and gaps of ``rows`` (``a``, ``b`` key, ``lo``, ``hi`` bounds as numbers).

    Returns ``a, b, kind, lo, hi``.
    """
    rows = rows.select("a", "b", F.floor(F.col("lo") / F.lit(cell_us)).cast("long").alias("cell"), "lo", "hi")
    leaves = rows.mapInArrow(_leaf, _LEAF)
    ends = rows.groupBy("a", "b", "cell").agg(F.max("hi").alias("hi"))
    earlier = W.partitionBy("a", "b").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.withColumn("carry", F.max("hi").over(earlier)).withColumn("top", F.max("hi").over(W.partitionBy("a", "b")))
    carried = carry.filter(F.col("carry").isNotNull()).select("a", "b", "cell", F.lit(1).alias("tag"), F.col("carry").alias("lo"), F.col("carry").alias("hi"))
    nodes = leaves.select("a", "b", "cell", F.lit(0).alias("tag"), "lo", "hi").unionByName(carried).repartition("a", "b", "cell").sortWithinPartitions("a", "b", "cell").mapInArrow(_node, _NODE)
    # The end of a key's very last period: one row for each key.
    tops = ends.groupBy("a", "b").agg(F.max("hi").alias("hi")).select("a", "b", F.lit((1 << 62)).alias("cell"), F.lit(3).alias("tag"), F.col("hi").alias("lo"), "hi")
    seq = W.partitionBy("a", "b").orderBy("cell", F.col("tag").desc())
    edges = nodes.filter("tag >= 2").unionByName(tops).withColumn("end", F.lead("hi").over(seq)).filter("tag = 2")
    return nodes.filter("tag < 2").select("a", "b", F.when(F.col("tag") == 0, "gap").otherwise("period").alias("kind"), "lo", "hi").unionByName(edges.select("a", "b", F.lit("period").alias("kind"), "lo", F.col("end").alias("hi")))


def _name(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def p5_found(spark, sf_dir: str) -> DataFrame:
    obs = table(spark, sf_dir, "runtime_observations")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = obs.select(_name("source_name").alias("a"), _name("target_name").alias("b"), us("observed_from").alias("lo"), us("observed_to").alias("hi"))
    rows = rows.filter((F.col("a") != "") & (F.col("b") != "") & (F.col("lo") <= F.col("hi")))
    out = periods_and_gaps(rows)
    return out.select(F.col("a").alias("source_name"), F.col("b").alias("target_name"), "kind", F.col("lo").alias("from_us"), F.col("hi").alias("to_us"))
