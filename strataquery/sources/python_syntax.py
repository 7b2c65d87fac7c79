"""Symbols and relations of Python files by the compiler's own parser, as an Arrow map."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_OUT = "repository string, path string, fact string, kind string, name string, line int, end_line int"


def facts(text: str) -> list[tuple[str, str, str, int, int]]:
    """(symbol or relation, kind, name, first line, last line) of one file; none if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append(("symbol", "class", node.name, node.lineno, node.end_lineno))
            out += [("relation", "extends", ast.unparse(b), node.lineno, node.lineno) for b in node.bases]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("symbol", "function", node.name, node.lineno, node.end_lineno))
        elif isinstance(node, ast.Call):
            out.append(("relation", "call", ast.unparse(node.func), node.lineno, node.lineno))
        elif isinstance(node, ast.Import):
            out += [("relation", "import", a.name, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("relation", "import", "." * node.level + (node.module or ""), node.lineno, node.lineno))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (repository, path, text) that end in .py; files delivered twice are told by ``file_id``."""
    known = "file_id" in files.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for repo, path, text, file_id in zip(*(b.column(i).to_pylist() for i in range(4))):
                for nth, fact in enumerate(facts(text)):
                    for c, v in zip(cols, (repo, path, *fact, file_id, nth)):
                        c.append(v)
            types = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["repository", "path", "fact", "kind", "name", "line", "end_line", "file_id", "nth"])

    picked = files.filter(F.col("text").isNotNull() & F.endswith("path", F.lit(".py"))).select("repository", "path", "text", (F.col("file_id").cast("long") if known else F.lit(None).cast("long")).alias("file_id"))
    out = picked.mapInArrow(run, _OUT + ", file_id long, nth int")
    return (out.distinct() if known else out).drop("file_id", "nth")
