"""Deeply nested records as flat tables with parent-child links.

Plan: columnar shredding.  For every repeated path the records of an Arrow batch become two level
sequences: the repetition level says at which list a value starts anew, the definition level how
much of its path exists.  Both come from the list offsets alone, vectorised and without walking
objects.  A table of a repeated ancestor is then rebuilt from the sequences only: a record starts
where the repetition level is 0, an index counts the repetitions of its own level since the last
shallower one, and a row exists where the ancestor is defined.  JSON texts of any shape feed the
same sequences from a parser.  Shredding is local to a record, so there is no shuffle; a record is
the largest thing a task holds.

Defined results: a null or missing list gives no rows; nulls (and in JSON anything that is no
object) in a list give no row but keep their index; an object without fields is a row; a lone JSON
object in the place of a list is its element 0; a text may be an object or a JSON string that holds
one, any other text - also null, empty or malformed ones - gives no rows; repeated records give
their rows once where ``dedupe`` is asked for; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import table

#: Definition levels that one list on a path adds: list present, element present, element not null.
STEP = 3


def shred(column: pa.Array, path: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
    """Level sequences of a list-of-struct column for ``path`` (the names of its lists, outermost first).

    Returns repetition levels, definition levels, for each entry its place among the innermost
    structs (-1 where there is none), and those structs.
    """
    n = len(column)
    rep, dfn, at, alive = np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n), np.ones(n, bool)
    here, structs = column, None
    for depth, name in enumerate(path, 1):
        if depth > 1:
            here = structs.field(name)
        if pa.types.is_null(here.type):
            return rep, dfn, np.full(len(rep), -1), None
        offsets = here.offsets.to_numpy().astype(np.int64)
        valid = here.is_valid().to_numpy(zero_copy_only=False)
        structs = here.values
        safe = np.where(alive, at, 0)
        present = alive & (valid[safe] if len(valid) else False)
        lens = np.where(present, (offsets[1:] - offsets[:-1])[safe] if len(valid) else 0, 0)
        many = np.maximum(lens, 1)
        src = np.repeat(np.arange(len(rep)), many)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        has = lens[src] > 0
        child = np.where(has, (offsets[:-1][safe] if len(valid) else np.zeros(len(safe), np.int64))[src] + nth, 0)
        ok = structs.is_valid().to_numpy(zero_copy_only=False)
        filled = has & (ok[child] if len(ok) else False)
        rep = np.where(nth > 0, np.int16(depth), rep[src]).astype(np.int16)
        dfn = (dfn[src] + present[src].astype(np.int16) + has + filled).astype(np.int16)
        at, alive = np.where(filled, child, -1), filled
    return rep, dfn, at, structs


def shred_json(doc: object, path: list[str]) -> tuple[list[int], list[int], list[object]]:
    """The same sequences for a parsed JSON object, with the objects themselves."""
    rep, dfn, objs = [0], [0], [doc if isinstance(doc, dict) else None]
    for depth, name in enumerate(path, 1):
        r2, d2, o2 = [], [], []
        for r, d, o in zip(rep, dfn, objs):
            inner = o.get(name) if o is not None else None
            if isinstance(inner, dict):
                inner = [inner]
            if not isinstance(inner, list):
                r2.append(r), d2.append(d), o2.append(None)
            elif not inner:
                r2.append(r), d2.append(d + 1), o2.append(None)
            else:
                for k, e in enumerate(inner):
                    obj = isinstance(e, dict)
                    r2.append(depth if k else r), d2.append(d + 2 + obj), o2.append(e if obj else None)
        rep, dfn, objs = r2, d2, o2
    return rep, dfn, objs


def assemble(rep: np.ndarray, dfn: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of the ancestor ``depth`` lists down, from the level sequences alone.

    Returns the entries that are rows, their record numbers, and their index at each list.
    """
    record = np.cumsum(rep == 0) - 1
    rows = np.flatnonzero(dfn >= STEP * depth)
    index = []
    for level in range(1, depth + 1):
        count = np.cumsum(rep == level)
        reset = np.maximum.accumulate(np.where(rep < level, np.arange(len(rep)), 0)) if len(rep) else rep
        index.append((count - count[reset])[rows].astype(np.int32))
    return rows, record[rows], index


def _ids(n: int, ids: np.ndarray, tag: int, index: list[np.ndarray], width: int) -> list[pa.Array]:
    return [pa.array(ids), pa.array(np.full(n, tag, np.int32)), *(pa.array(index[i] if i < len(index) else np.full(n, -1, np.int32)) for i in range(width))]


def _schema(width: int) -> str:
    return "record_id long, path_no int, " + ", ".join(f"i{k} int" for k in range(width))


def _named(rows: DataFrame, paths: list[list[str]], extra: list[str] = ()) -> DataFrame:
    """Spell node and parent paths from path numbers and indexes."""

    def spell(steps: list[str]) -> Column:
        if not steps:
            return F.lit("")
        parts: list[Column] = []
        for k, name in enumerate(steps):
            parts += [F.lit(("." if k else "") + name + "["), F.col(f"i{k}").cast("string"), F.lit("]")]
        return F.concat(*parts)

    def pick(cut: int) -> Column:
        out = None
        for no, steps in enumerate(paths):
            value = spell(steps[: len(steps) - cut])
            out = F.when(F.col("path_no") == no, value) if out is None else out.when(F.col("path_no") == no, value)
        return out

    return rows.select("record_id", pick(0).alias("node"), pick(1).alias("parent_node"), *extra)


def nodes(df: DataFrame, record_id: str, paths: list[list[str]]) -> DataFrame:
    """``record_id, node, parent_node`` of every object under the typed array ``paths``."""
    width = max(map(len, paths))
    roots = list(dict.fromkeys(p[0] for p in paths))
    names = [f"i{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for no, path in enumerate(paths):
                rep, dfn, _, _ = shred(b.column(1 + roots.index(path[0])), path)
                rows, record, index = assemble(rep, dfn, len(path))
                yield pa.RecordBatch.from_arrays(_ids(len(rows), ids[record], no, index, width), names=["record_id", "path_no", *names])

    return _named(df.select(F.col(record_id).cast("long").alias("record_id"), *roots).mapInArrow(run, _schema(width)), paths)


def flat_table(df: DataFrame, record_id: str, path: list[str]) -> DataFrame:
    """One table: the scalar fields of the objects under ``path``, with node and parent link."""
    kind = df.schema[path[0]].dataType.elementType
    for name in path[1:]:
        kind = kind[name].dataType.elementType
    leaves = [f for f in kind.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    # Names of fields and of our own columns may clash: fields travel as f0, f1, ...
    out = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("path_no", T.IntegerType()), *[T.StructField(f"i{k}", T.IntegerType()) for k in range(len(path))], *[T.StructField(f"f{k}", f.dataType) for k, f in enumerate(leaves)]])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rep, dfn, at, structs = shred(b.column(1), path)
            rows, record, index = assemble(rep, dfn, len(path))
            values = [structs.field(f.name).take(pa.array(at[rows])) for f in leaves] if structs is not None and len(rows) else [pa.nulls(len(rows), pa.string()) for _ in leaves]
            if len(rows):
                yield pa.RecordBatch.from_arrays([*_ids(len(rows), ids[record], 0, index, len(path)), *values], names=out.names)

    rows = df.select(F.col(record_id).cast("long").alias("record_id"), path[0]).mapInArrow(run, out)
    return _named(rows, [path], [F.col(f"f{k}").alias(f.name if f.name not in ("record_id", "node", "parent_node") else f"{f.name}_value") for k, f in enumerate(leaves)])


def _refuse(token: str):
    raise ValueError(token)


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, also one wrapped in a JSON string; else None."""
    if not text:
        return None
    try:
        doc = json.loads(text, parse_constant=_refuse, parse_int=str)
        if isinstance(doc, str):
            doc = json.loads(doc, parse_constant=_refuse, parse_int=str)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def json_nodes(df: DataFrame, record_id: str, text: str, paths: list[list[str]], dedupe: bool = True) -> DataFrame:
    """``record_id, node, parent_node`` of every object under ``paths`` in JSON texts."""
    width = max(map(len, paths))
    names = [f"i{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            seqs: list[tuple[list[int], list[int]]] = [([], []) for _ in paths]
            for value in b.column(1):
                doc = parse_object(value.as_py())
                for (rep, dfn), path in zip(seqs, paths):
                    r, d, _ = shred_json(doc, path)
                    rep += r
                    dfn += d
            for no, ((rep, dfn), path) in enumerate(zip(seqs, paths)):
                rows, record, index = assemble(np.array(rep, np.int16), np.array(dfn, np.int16), len(path))
                yield pa.RecordBatch.from_arrays(_ids(len(rows), ids[record], no, index, width), names=["record_id", "path_no", *names])

    rows = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, _schema(width))
    # Repeated records are told apart by their slim rows, so no text is ever shuffled.
    return _named(rows.distinct() if dedupe else rows, paths)


ADVISORY_PATHS = [["severity"], ["affected"], ["refs"], ["affected", "severity"], ["affected", "ranges"], ["affected", "ranges", "events"]]
SARIF_PATHS = [["runs"], ["runs", "results"], ["runs", "results", "locations"]]


def p4_found(spark, sf_dir: str) -> DataFrame:
    cols = ["table_name", "record_id", "node", "parent_node"]
    a = nodes(table(spark, sf_dir, "advisories"), "record_id", ADVISORY_PATHS).withColumn("table_name", F.lit("advisories"))
    s = json_nodes(table(spark, sf_dir, "sarif_reports"), "report_id", "text", SARIF_PATHS).withColumn("table_name", F.lit("sarif_reports"))
    return a.select(cols).unionByName(s.select(cols))


def p4_events_table(spark, sf_dir: str) -> DataFrame:
    """The flat table of version range events, each row naming its range."""
    return flat_table(table(spark, sf_dir, "advisories"), "record_id", ["affected", "ranges", "events"])
