"""Versions as sortable keys, ranges over them, and what follows from both.

A key is a string that sorts as the version does, so comparing, ranging and taking minima stay plain
column expressions.  Numbers of any length sort by a prefix that counts their digits; all parts count,
trailing zeros apart.  ``semver_key`` covers npm, Cargo, Go and
NuGet precedence (a pre-release sorts before its release, numeric identifiers before words);
``maven_key`` ranks the well-known qualifiers, ``sp`` after the release; ``pep440_key`` orders dev,
alpha, beta, candidate, release and post.  ``loose_parts`` reads any text as its runs of digits.
Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _counted(c: Column) -> Column:
    """A number behind its count of digits, and that behind its own: 7 is 117, 25 is 1225."""
    plain = F.regexp_replace(c, "^0+(?=[0-9])", "")
    size = F.length(plain).cast("string")
    return F.concat(F.length(size).cast("string"), size, plain)


def loose_parts(version: Column) -> Column:
    """The runs of digits, as numbers."""
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))


def loose_key(version: Column) -> Column:
    """Numeric runs, trailing zeros apart: equal keys for 1.2 and 1.2.0."""
    parts = F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0))
    return F.regexp_replace(F.array_join(F.transform(parts, _counted), "."), r"(?:(?:^|\.)110)+$", "")


def _core(version: Column) -> Column:
    """The leading dotted numbers, closed by a sign that sorts before the dot of a further part."""
    plain = F.regexp_replace(F.trim(version), "^[vV=]+", "")
    numbers = F.regexp_replace(F.regexp_extract(plain, r"^[0-9]+(?:\.[0-9]+)*", 0), r"(?:(?:^|\.)0+)+$", "")
    return F.concat(F.array_join(F.transform(F.regexp_extract_all(numbers, F.lit("[0-9]+"), F.lit(0)), _counted), "."), F.lit("!"))


def semver_key(version: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(version), "^[vV=]+", ""), r"\+.*$", "")
    pre = F.regexp_extract(plain, r"^[0-9.]*-(.+)$", 1)
    idents = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _counted(x))).otherwise(F.concat(F.lit("1"), x)))
    return F.concat(_core(plain), F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(idents, "!"))))


def maven_key(version: Column) -> Column:
    low = F.lower(F.trim(version))
    qualifier = F.regexp_extract(low, r"^[0-9.]*[-.]?([a-z]*)", 1)
    number = F.regexp_extract(low, r"^[0-9.]*[-.]?[a-z]+[-.]?([0-9]*)", 1)
    rank = F.when(qualifier.isin("alpha", "a"), "1").when(qualifier.isin("beta", "b"), "2").when(qualifier.isin("milestone", "m"), "3").when(qualifier.isin("rc", "cr"), "4").when(qualifier == "snapshot", "5").when(qualifier.isin("", "ga", "final", "release"), "6").when(qualifier == "sp", "7").otherwise(F.concat(F.lit("8"), qualifier))
    return F.concat(_core(F.regexp_extract(low, r"^[0-9.]*[0-9]", 0)), F.lit("-"), rank, F.lit("."), _counted(F.when(number == "", "0").otherwise(number)))


def pep440_key(version: Column) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(version)), r"^v", ""), r"\+.*$", "")
    epoch = F.regexp_extract(low, r"^([0-9]+)!", 1)
    body = F.regexp_replace(low, r"^[0-9]+!", "")
    tag = F.regexp_extract(body, r"^[0-9.]*?[-_.]?(dev|alpha|beta|preview|post|pre|rev|rc|a|b|c|r)[-_.]?[0-9]*", 1)
    number = F.regexp_extract(body, r"^[0-9.]*?[-_.]?(?:dev|alpha|beta|preview|post|pre|rev|rc|a|b|c|r)[-_.]?([0-9]*)", 1)
    rank = F.when(tag == "dev", "0").when(tag.isin("a", "alpha"), "1").when(tag.isin("b", "beta"), "2").when(tag.isin("rc", "c", "pre", "preview"), "3").when(tag == "", "4").otherwise("5")
    return F.concat(_counted(F.when(epoch == "", "0").otherwise(epoch)), F.lit("!"), _core(F.regexp_extract(body, r"^[0-9]+(?:\.[0-9]+)*", 0)), F.lit("-"), rank, F.lit("."), _counted(F.when(number == "", "0").otherwise(number)))


def version_key(ecosystem: Column, version: Column) -> Column:
    low = F.lower(ecosystem)
    return F.when(low == "maven", maven_key(version)).when(low == "pypi", pep440_key(version)).otherwise(semver_key(version))


def stable(version: Column) -> Column:
    """No pre-release qualifier, and a number at all."""
    low = F.lower(F.trim(version))
    return ~low.rlike(r"(?:^|[0-9._+-])(?:snapshot|alpha|beta|preview|milestone|dev|rc|cr|ea|pre)(?:[0-9._+-]|$)") & low.rlike("[0-9]")


def status(current: Column, latest: Column, exact: Column) -> Column:
    """How a declared version stands to the latest stable one."""
    here, there = F.regexp_replace(F.trim(current), "^v", ""), F.regexp_replace(F.trim(latest), "^v", "")
    return (
        F.when(F.coalesce(there, F.lit("")) == "", "unavailable").when(~exact, "unresolved").when(F.lower(here) == F.lower(there), "current")
        .when(~stable(here), "prerelease").when(loose_key(here) > loose_key(there), "ahead").otherwise("behind")
    )


def distance(current: Column, latest: Column, state: Column) -> Column:
    part = lambda c, i: F.coalesce(F.try_element_at(loose_parts(c), F.lit(i)), F.lit(0))
    return (
        F.when(state == "current", "none").when(state != "behind", "unknown").when(part(current, 1) != part(latest, 1), "major")
        .when(part(current, 2) != part(latest, 2), "minor").when(part(current, 3) != part(latest, 3), "patch").otherwise("unknown")
    )


def in_events(version: Column, events: Column, key) -> Column:
    """Whether ``version`` lies in a range given by introduced, fixed, last_affected and limit events.

    ``key`` maps a version column to its sort key.  Events are taken in version order ("0" first, "*"
    last); the state after the last one that applies decides.
    """
    place = lambda v: F.when(v == "0", "").when(v == "*", "￿").otherwise(key(v))
    some = lambda v: F.coalesce(v, F.lit("")) != ""
    first = lambda e: F.coalesce(F.nullif(e["introduced"], F.lit("")), F.nullif(e["fixed"], F.lit("")), F.nullif(e["last_affected"], F.lit("")), F.nullif(e["limit"], F.lit("")))
    mine = key(version)
    marks = F.transform(
        F.filter(events, lambda e: first(e).isNotNull()),
        lambda e: F.struct(place(first(e)).alias("k"), F.when(some(e["introduced"]), 0).when(some(e["fixed"]), 1).when(some(e["last_affected"]), 2).otherwise(3).alias("kind")),
    )
    # An introduction opens the range when it is reached; an end closes it unless the version lies before.
    step = lambda state, m: F.when(state == 2, 2).when(m["kind"] == 0, F.when(mine >= m["k"], 1).otherwise(0)).when((state == 1) & (((m["kind"] == 2) & (mine <= m["k"])) | ((m["kind"] != 2) & (mine < m["k"]))), 2).otherwise(0)
    return F.aggregate(F.array_sort(marks), F.lit(0), lambda s, m: step(s, m)) >= 1


def nearest_fixed(version: Column, ranges: Column, key) -> Column:
    """The least fixed version above ``version`` in any range."""
    fixed = F.transform(F.filter(F.flatten(F.transform(F.filter(ranges, lambda r: r["events"].isNotNull()), lambda r: r["events"])), lambda e: F.coalesce(e["fixed"], F.lit("")) != ""), lambda e: F.struct(key(e["fixed"]).alias("k"), e["fixed"].alias("v")))
    return F.array_min(F.filter(fixed, lambda x: x["k"] > key(version)))["v"]
