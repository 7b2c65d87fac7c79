"""Compiler indexes in the SCIP protobuf format, read into tables and written.

Only the fields that the tables need are read; unknown fields are skipped by their wire type.  Lines are
0-based as in the format.  A duplicate document, an empty symbol or an impossible range rejects the
whole index, so an index is one row in and its documents' rows out; documents with the same symbol as the
external ones replace them, and symbols that only occur are made up from their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import trimmed

_SYMBOLS = "index_id long, symbol string, path string, external boolean, display string, kind int, relationships array<struct<symbol:string,reference:boolean,implementation:boolean,type_definition:boolean,definition:boolean>>"
_OCCURRENCES = "index_id long, path string, language string, symbol string, start_line int, start_char int, end_line int, end_char int, definition boolean"


class ScipError(ValueError):
    """Why an index is rejected."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ScipError("a number isn't complete")
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: integers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ScipError("a field is longer than its message")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
            if at > len(data):
                raise ScipError("a field is longer than its message")
            continue
        else:
            raise ScipError(f"wire type {wire}")
        yield tag >> 3, value


def _text(value: int | bytes) -> str:
    if not isinstance(value, bytes):
        raise ScipError("a text is a number")
    return value.decode("utf-8", "replace")


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def _symbol(data: bytes) -> dict:
    out: dict = {"symbol": "", "display": "", "kind": 0, "relationships": []}
    for n, v in fields(data):
        if n == 1:
            out["symbol"] = _text(v)
        elif n == 4:
            rel = {"symbol": "", "reference": False, "implementation": False, "type_definition": False, "definition": False}
            for k, x in fields(v):
                rel[{1: "symbol", 2: "reference", 3: "implementation", 4: "type_definition", 5: "definition"}.get(k, "")] = _text(x) if k == 1 else bool(x)
            rel.pop("", None)
            out["relationships"].append(rel)
        elif n == 5:
            out["kind"] = int(v)
        elif n == 6:
            out["display"] = _text(v)
    if not out["symbol"]:
        raise ScipError("a symbol has no name")
    return out


def _occurrence(data: bytes) -> tuple[str, int, int, int, int, bool]:
    spot: list[int] = []
    symbol, roles = "", 0
    for n, v in fields(data):
        if n == 1:
            spot += _numbers(v)
        elif n == 2:
            symbol = _text(v)
        elif n == 3:
            roles = int(v)
    if len(spot) == 3:
        spot = [spot[0], spot[1], spot[0], spot[2]]
    if len(spot) != 4 or (spot[2], spot[3]) < (spot[0], spot[1]) or max(spot) >= 1 << 31:
        raise ScipError("a range is impossible")
    return symbol, *spot, bool(roles & 1)


def read_index(data: bytes) -> tuple[list[dict], list[tuple]]:
    """Symbols and occurrences (path, language, symbol, range, definition) of one index."""
    symbols: dict[tuple[str, str], dict] = {}
    external: list[dict] = []
    occurrences: list[tuple] = []
    seen: set[str] = set()
    for n, v in fields(data):
        if n == 3:
            external.append(_symbol(v))
        if n != 2:
            continue
        path = language = ""
        own: list[dict] = []
        spots: list[tuple] = []
        for k, x in fields(v):
            if k == 1:
                path = _text(x)
            elif k == 4:
                language = _text(x)
            elif k == 2:
                spots.append(_occurrence(x))
            elif k == 3:
                own.append(_symbol(x))
        if not path or path in seen:
            raise ScipError("a document has no path of its own")
        seen.add(path)
        for s in own:
            symbols[("" if not s["symbol"].startswith("local ") else path, s["symbol"])] = {**s, "path": path, "external": False}
        occurrences += [(path, language, *o) for o in spots if o[0]]
    for s in external:
        symbols.setdefault(("", s["symbol"]), {**s, "path": "", "external": True})
    for o in occurrences:
        scope = o[0] if o[2].startswith("local ") else ""
        symbols.setdefault((scope, o[2]), {"symbol": o[2], "path": o[0], "external": False, "display": "", "kind": 0, "relationships": []})
    return [symbols[k] for k in sorted(symbols)], occurrences


def _read(indexes: DataFrame, schema: str, rows) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(indexes.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    got = rows(i, *read_index(data))
                except ScipError:
                    continue
                yield pa.RecordBatch.from_pylist(got, schema=arrow)

    return indexes.filter("data is not null").select(F.col("index_id").cast("long"), F.col("data").cast("binary")).mapInArrow(run, schema)


def symbols(indexes: DataFrame) -> DataFrame:
    """One row a symbol of every index (``index_id``, ``data``) that isn't rejected."""
    return _read(indexes, _SYMBOLS, lambda i, s, _: [{"index_id": i, **x} for x in s])


def occurrences(indexes: DataFrame) -> DataFrame:
    """One row an occurrence."""
    names = ["path", "language", "symbol", "start_line", "start_char", "end_line", "end_char", "definition"]
    return _read(indexes, _OCCURRENCES, lambda i, _, o: [{"index_id": i, **dict(zip(names, x))} for x in o])


def _put(number: int, value: int | bytes) -> bytes:
    def var(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out) + bytes([n])

    return var(number << 3) + var(value) if isinstance(value, int) else var(number << 3 | 2) + var(len(value)) + value


def write_index(documents: list[tuple[str, str, list[tuple[str, int, int, int, bool]], list[tuple[str, list[str]]]]]) -> bytes:
    """An index of documents (path, language, occurrences (symbol, line, from, to, definition), symbols (name, implemented ones))."""
    out = b""
    for path, language, spots, own in documents:
        doc = _put(1, path.encode()) + _put(4, language.encode())
        for symbol, line, lo, hi, definition in spots:
            doc += _put(2, _put(1, b"".join(_put(0, n)[1:] for n in (line, lo, hi))) + _put(2, symbol.encode()) + _put(3, int(definition)))
        for name, implemented in own:
            doc += _put(3, _put(1, name.encode()) + b"".join(_put(4, _put(1, x.encode()) + _put(3, 1)) for x in implemented))
        out += _put(2, doc)
    return out


def definition_names(occurrences_: DataFrame) -> DataFrame:
    """``path, name, line`` (from 1) of definitions: the last descriptor of the symbol without its signs."""
    last = F.regexp_extract("symbol", r"([^/#.():\[\]`\s]+)[`]?[/#.():\[\]]*$", 1)
    return occurrences_.filter("definition").select("index_id", "path", trimmed(last).alias("name"), (F.col("start_line") + 1).alias("line"))
