"""Entities other than files: repositories, pages, saved searches; compact results, orders and cursors."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bounded
from ..plans.filters import any_path_predicate
from ..plans.lang import Query
from ..plans.predicates import basename, field_predicate, folded_equal, text_predicate, validate

#: Fixed value: files of one page of a structural search.
FILES_A_PAGE = 32


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank, trimmed; '' if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def search_repositories(repositories: DataFrame, query: Query, limit: int) -> DataFrame:
    """Repositories by what the catalogue says of them: the text and every included text, none excluded."""
    validate(query, "repository")
    hay = F.concat_ws("\n", "name", "origin_url", "default_revision", "head_commit", "indexed_commit", "scan_state", "index_state")
    hits = repositories.filter(text_predicate(query, hay, include="all"))
    revision = first_filled(F.col("indexed_commit"), F.col("head_commit"))
    return hits.select("id", F.col("name").alias("title"), F.col("origin_url").alias("summary"), revision.alias("revision"), F.concat(F.col("name"), F.lit("@"), F.substring(revision, 1, 8), F.lit(":repository")).alias("citation")).orderBy(F.lower("title"), "id").limit(limit)


def search_pages(pages: DataFrame, query: Query, limit: int) -> DataFrame:
    """Ready or stale pages whose text or supporting files fit.

    ``pages``: repository, revision, slug, title, summary, body, status, files (array of paths).
    """
    validate(query, "wiki_page")
    hay = F.concat_ws("\n", "slug", "title", "summary", "body", F.array_join("files", "\n"))
    hits = pages.filter(F.col("status").isin("ready", "stale") & text_predicate(query, hay) & any_path_predicate(query, F.col("files")))
    return hits.select("repository", "slug", "title", "summary", bounded(F.col("body"), 12_000).alias("detail"), F.concat(F.col("repository"), F.lit("@"), F.substring("revision", 1, 8), F.lit(":wiki/"), F.col("slug")).alias("citation")).orderBy(F.lower("repository"), "slug").limit(limit)


def search_routes(routes: DataFrame, query: Query, limit: int) -> DataFrame:
    """Routes whose label, repository or path hold the text and any included text, none excluded.

    ``routes``: repository, path, verb, route.
    """
    validate(query, "route")
    label = F.concat_ws(" ", "verb", "route")
    keep = text_predicate(query, F.concat_ws("\n", label, "repository", "path")) & field_predicate(query, "repository", F.col("repository"), folded_equal) & field_predicate(query, "path", F.col("path")) & field_predicate(query, "file", basename(F.col("path")))
    return routes.filter(keep).select(label.alias("title"), "repository", "path").distinct().orderBy(F.lower("repository"), "path", "title").limit(limit)


def visible_searches(saved: DataFrame, viewer: str) -> DataFrame:
    """Saved searches of one's own and shared ones, managed ones first."""
    return saved.filter((F.col("author") == viewer) | (F.col("visibility") == "shared")).orderBy(F.desc("managed"), F.lower("title"), "id")


#: What a compact result drops: texts, scores and what explains them.
_HEAVY = ["text", "line", "before", "after", "fragments", "score", "weight", "ranking", "actions", "summary", "detail", "metadata"]


def compact(results: DataFrame) -> DataFrame:
    """Identities and places only."""
    return results.drop(*[c for c in _HEAVY if c in results.columns])


def reference_order() -> list[Column]:
    return [F.lower("repository"), F.col("path"), F.col("line"), F.col("kind"), F.col("target")]


def symbol_order() -> list[Column]:
    """Compiler evidence before syntax, then by name and place."""
    return [F.when(F.col("source") == "compiler", 0).otherwise(1), F.lower("name"), F.lower("repository"), F.col("path"), F.col("line")]


def declaration_order() -> list[Column]:
    return [F.lower("repository"), F.col("path"), F.col("ecosystem"), F.lower("package"), F.col("declared")]


def distinct_references(references: DataFrame) -> DataFrame:
    """One row for each place, kind, target and receiver."""
    keys = [c for c in ("repository", "path", "line", "kind", "target", "receiver") if c in references.columns]
    return references.dropDuplicates(keys)


def encode_cursor(index: str, request: dict, key: list) -> str:
    """An opaque place in a listing, bound to the index and the request it belongs to."""
    digest = hashlib.sha256(json.dumps([index, request], sort_keys=True).encode()).hexdigest()
    return base64.urlsafe_b64encode(json.dumps({"d": digest, "k": key}).encode()).decode()


def decode_cursor(cursor: str, index: str, request: dict) -> list:
    """The key a cursor stands for; an error if it belongs to another index or request."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        digest, key = body["d"], body["k"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor can't be read") from e
    if digest != hashlib.sha256(json.dumps([index, request], sort_keys=True).encode()).hexdigest():
        raise ValueError("the cursor belongs to another request")
    return key


def after_key(rows: DataFrame, keys: list[str], after: list | None, limit: int = FILES_A_PAGE) -> DataFrame:
    """The next ``limit`` rows behind a key in ascending order; one more tells that there are others."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, after):
            beyond = beyond | (equal & (F.col(k) > F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        rows = rows.filter(beyond)
    return rows.orderBy(*keys).limit(limit + 1)


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, each row with how many there are in all."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))
