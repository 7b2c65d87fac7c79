"""Generated, minified, vendored and data files among source files.

Plan: one map reads each file once and leaves a slim row: what its path and content say by
themselves, and the fingerprints of its normalized token stream.  Tokens are words and single signs
without white space; k-grams of token hashes are winnowed, so any shared run of ``GRAM + WINDOW - 1``
tokens shares a fingerprint.  A file is a copy if ``SHARE`` of its fingerprints stand together in one
other file, and the files that hold them so lie in ``REPOSITORIES`` or more unrelated repositories, its
own among them; so how large the corpus is does not matter, and idioms spread over many files make no
copy.  Repositories that largely hold the same files - forks and mirrors - are one family and count once.  Equal fingerprint sets are one set from the start, so exact copies never make pairs.  Of each
set only its rarest fingerprints look for partners, as many as a partner cannot miss entirely
(prefix filter: no pair is lost); a set with too many fingerprints of its own looks for none.  Each
pair found is then checked over the whole sets.  Hot fingerprints are salted in the joins.

By themselves, files are told by: the names that lock files and third-party folders have (whole path
segments only), a header comment that states generation, wherever it stands before the first code, the
shape of squeezed text (long lines with hardly a blank), and the share of lines that hold only
literals.  Mentions of such headers in prose, strings or names decide nothing.  Notices of copyright
or licence decide nothing either, as a project's own files bear them too.

Defined results: null contents are judged by the path alone; empty texts are hand-written; a file
delivered twice counts once, flagged if any copy is; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import replicated, salted
from ..session import Scratch, spread, table
from .components import components
from .textarrays import LETTER, NUMBER, SPACE, blocks, classes, codepoints, prefix_hashes, span_hashes

#: Tokens of a gram, grams of a winnowing window, unrelated repositories that hold a copy, share of a copy.
GRAM, WINDOW, REPOSITORIES, SHARE = 20, 15, 2, 0.75
#: Bands of four hashes in a repository's signature, and distinct files it takes to tell relatives.
BANDS, LEAST_SETS = 16, 8
#: Names of lock files.
LOCKS = frozenset(
    ["Cargo.lock", "Gemfile.lock", "Pipfile.lock", "composer.lock", "deno.lock", "flake.lock", "go.sum", "gradle.lockfile", "mix.lock", "npm-shrinkwrap.json", "package-lock.json", "packages.lock.json", "pdm.lock", "pnpm-lock.yaml", "poetry.lock", "pubspec.lock", "uv.lock", "yarn.lock"]
)
#: Folders of third-party code.
FOREIGN = frozenset(["_vendor", "bower_components", "external", "jspm_packages", "node_modules", "site-packages", "third-party", "third_party", "thirdparty", "vendor", "vendored"])
_MARK = r"^[ \t]*(?:#+|//+!?|/\*+!?|\*+|--|;+|<!--)[ \t]*"
_GENERATED = re.compile(
    _MARK + r"(?:Code generated (?:by .*)?DO NOT EDIT|<auto-generated\b|@generated\b|AUTO-?GENERATED FILE\b|(?:This file (?:is|was) )?(?:auto(?:matically)?[ -]?)?generated (?:by|from|with)\b.*(?:do not (?:edit|modify)|;)|(?:This file (?:is|was) )?auto(?:matically)?[ -]?(?:generated|created|produced|written) by\b|.*\bmachine[ -](?:written|generated|made)\b.*\b(?:do not edit|instead)\b)",
    re.I | re.M,
)
#: Each piece of a line is taken once and for all (``?>``, ``*+``), so a line costs time in proportion to its length.
_LITERAL = re.compile(r"""^[ \t]*+(?>(?>[-+]?(?>0[xX][0-9a-fA-F]++|\d[\d_]*+(?:\.\d++)?(?:[eE][-+]?\d++)?)[lLfF]?|"(?>[^"\\]++|\\.)*+"|'(?>[^'\\]++|\\.)*+'|null|None|nil|true|false|True|False)[ \t]*+[,+]?[ \t]*+|[\[\](){}],?[ \t]*+)++;?$""")
_LINES = re.compile(r"\r\n|\n|\r")
#: Comments and blanks before the first code; prologues of PHP, XML and strict JavaScript count as blank.
_LEAD = re.compile(r"""(?:[\s\ufeff]++|(?:#|//|--|;)[^\r\n]*+|/\*(?s:.)*?(?:\*/|\Z)|<!--(?s:.)*?(?:-->|\Z)|<\?xml[^>]*+>|<\?php\b|"use strict";?|'use strict';?)*+""")


def by_path(path: str | None) -> str | None:
    parts = (path or "").split("/")
    if parts[-1] in LOCKS:
        return "generated"
    if not FOREIGN.isdisjoint(parts[:-1]):
        return "vendored"
    return None


def by_content(path: str | None, text: str | None) -> str | None:
    """What a file's own content says of its origin."""
    if not text:
        return None
    lines = _LINES.split(text)
    if _GENERATED.search("\n".join(_LINES.split(_LEAD.match(text)[0]))):
        return "generated"
    full = [x for x in lines if x.strip()]
    if not full:
        return None
    chars = sum(map(len, full))
    longest = max(map(len, full))
    blank = sum(x.count(" ") + x.count("\t") for x in full)
    code = not (path or "").endswith(".json")
    literal = sum(len(x) for x in full if _LITERAL.match(x))
    if code and literal >= 0.5 * chars and literal > 200:
        return "data"
    if longest > 300 and chars / len(full) > 110:
        words = len(re.findall(r"\w+", text))
        if code and longest > 0.5 * chars and re.search(r"[\"'`][A-Za-z0-9+/=_\-\\]{400,}", text):
            return "data"
        if blank < 0.12 * chars and words:
            return "minified"
    return None


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[np.ndarray]:
    """Distinct winnowed fingerprints of each text's token stream."""
    flat, offsets = codepoints(texts)
    if not len(flat):
        return [np.zeros(0, np.int64) for _ in texts]
    kind = classes()[flat]
    word = (kind == LETTER) | (kind == NUMBER) | (flat == ord("_"))
    starts = kind != SPACE
    starts[1:] &= ~(word[1:] & word[:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(flat))]
    starts[cut] = kind[cut] != SPACE
    at = np.flatnonzero(starts)
    # A word ends before the next token or blank; other tokens are one code point.
    stop = ~word
    stop_at = np.flatnonzero(stop)
    nxt = np.searchsorted(stop_at, at)
    end = np.where(word[at], np.r_[stop_at, len(flat)][nxt], at + 1)
    doc = np.searchsorted(offsets, at, "right") - 1
    end = np.minimum(end, offsets[doc + 1])
    tokens = span_hashes(prefix_hashes(flat), at, end)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    prefix = prefix_hashes(tokens & np.uint64(0xFFFFFFFF))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = hi - lo - gram + 1
        if n <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        k = np.arange(lo, lo + n)
        h = span_hashes(prefix, k, k + gram)
        w = min(window, n)
        picked = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)
        out.append(np.unique(picked).view(np.int64))
    return out


def families(holders: DataFrame, scratch: Scratch) -> DataFrame:
    """``repo, family``: repositories that largely hold the same files - forks, mirrors, renamed copies - are one family.

    Each repository with ``LEAST_SETS`` distinct files or more has a signature of 64 least hashes over
    them, in 16 bands; two that agree in a band have most files in common.  Bands and repositories are the
    two sides of a graph, whose components are the families, so no pairs are made.
    """
    per = holders.groupBy("repo").agg(F.count("*").alias("n"), *[F.min(F.xxhash64("s", F.lit(i))).alias(f"h{i}") for i in range(4 * BANDS)]).filter(F.col("n") >= LEAST_SETS)
    bands = F.array(*[F.concat_ws(":", F.lit(f"band{i}"), *[F.col(f"h{4 * i + j}").cast("string") for j in range(4)]) for i in range(BANDS)])
    keys = scratch.save(per.select("repo", F.explode(bands).alias("v")), "bands")
    several = keys.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v")
    linked = components(keys.join(several, "v", "left_semi").select(F.concat(F.lit("repo:"), "repo").alias("u"), "v"), scratch)
    return linked.filter("startswith(node, 'repo:')").select(F.substring("node", 6, 30).cast("long").alias("repo"), F.col("root").alias("family"))


def copied(seen: DataFrame, scratch: Scratch, repositories: int, share: float) -> DataFrame:
    """``s`` of every fingerprint set that is a copy; ``seen`` has file_id, repo, s and prints."""
    some = seen.filter(F.size("prints") > 0)
    # A file delivered twice counts once, so it is in one repository only.
    holders = scratch.save(some.groupBy("file_id", "s").agg(F.min(F.coalesce("repo", F.lit(-1))).alias("repo")).select("s", "repo").distinct(), "holders")
    kin = families(holders, scratch)
    held = holders.join(kin, "repo", "left").select("s", F.coalesce("family", F.concat(F.lit("repo:"), "repo")).alias("family")).distinct()
    sets = scratch.save(some.groupBy("s").agg(F.any_value("prints").alias("prints")), "sets")
    posts = sets.select("s", F.size("prints").alias("size"), F.explode("prints").alias("p"))
    # Written, so that its size is known: a small table of shared fingerprints is sent to the posts, a large one meets them in a salted join.
    shared = scratch.save(posts.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    total = sets.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    rows, heavy = salted(posts, "p", "s", total, shared)
    # Fingerprints of one set only can't meet a partner; they are the rarest, so they use up the prefix.
    met = scratch.save(rows.join(replicated(shared, "p", heavy), ["p", "_salt"]).select("s", "size", "p", "n", "_salt"), "met")
    prefix = met.groupBy("s", "size").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("by")).withColumn("take", (F.size("by") - F.ceil(F.lit(share) * F.col("size")) + 1).cast("int")).filter("take > 0")
    seek = replicated(prefix.select(F.col("s").alias("a"), F.explode(F.slice("by", F.lit(1), F.col("take"))).alias("x")).select("a", F.col("x.p").alias("p")), "p", heavy)
    pairs = scratch.save(seek.join(met.select("p", "_salt", F.col("s").alias("b")), ["p", "_salt"]).filter("a <> b").select("a", "b").distinct(), "pairs")
    # Only sets that have a partner are compared whole.
    paired = scratch.save(sets.join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s", "left_semi"), "paired")
    one = lambda c: paired.select(F.col("s").alias(c), F.col("prints").alias(f"p{c}"))
    sure = pairs.join(one("a"), "a").join(one("b"), "b").filter(F.size(F.array_intersect("pa", "pb")) >= share * F.size("pa")).select("a", "b")
    where = sure.join(held.select(F.col("s").alias("b"), "family"), "b").select("a", "family").unionByName(held.select(F.col("s").alias("a"), "family"))
    return where.distinct().groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= repositories).select(F.col("a").alias("s"))


def classify(files: DataFrame, scratch: Scratch, repositories: int = REPOSITORIES, share: float = SHARE) -> DataFrame:
    """``file_id, kind`` of every file: generated, minified, vendored, data or handwritten."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, repos, paths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for rows, texts in blocks(b, 3):
                said = [by_path(paths[i]) or by_content(paths[i], t) for i, t in zip(rows.tolist(), texts)]
                prints = fingerprints(texts)
                # The name of a set: a digest of its sorted fingerprints.
                names = [hashlib.blake2b(p.tobytes(), digest_size=16).digest() for p in prints]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows.tolist()], pa.int64()), pa.array([repos[i] for i in rows.tolist()], pa.int64()), pa.array(said, pa.string()), pa.array(names, pa.binary()), pa.array([p.tolist() for p in prints], pa.list_(pa.int64()))],
                    names=["file_id", "repo", "said", "s", "prints"],
                )

    seen = spread(files.select(F.col("file_id").cast("long"), F.col("repository_id").cast("long"), F.col("path").cast("string"), F.col("content").cast("string"))).mapInArrow(run, "file_id long, repo long, said string, s binary, prints array<long>")
    seen = scratch.save(seen, "seen")
    copies = copied(seen, scratch, repositories, share).withColumn("copy", F.lit(True))
    rows, heavy = salted(seen.select("file_id", "said", "s"), "s", "file_id", seen.count())
    per = rows.join(replicated(copies, "s", heavy), ["s", "_salt"], "left").groupBy("file_id").agg(F.max("said").alias("said"), F.max("copy").alias("copy"))
    return per.select("file_id", F.coalesce("said", F.when(F.col("copy"), "vendored"), F.lit("handwritten")).alias("kind"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "source_files"), Scratch(spark, "provenance")).filter("kind <> 'handwritten'").select("file_id")


def p6_kinds(spark, sf_dir: str) -> DataFrame:
    """Every file with the kind it was told to be."""
    return classify(table(spark, sf_dir, "source_files"), Scratch(spark, "provenance"))
