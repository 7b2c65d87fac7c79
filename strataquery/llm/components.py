"""One group identifier for everything linked directly or through others.

Plan: connectivity by low-diameter decomposition.  At each level every vertex draws an exponential
shift from a hash of its name (so a recomputed task draws the same); clusters grow one hop a round,
all at once, a vertex joining the cluster whose shifted start reaches it first.  Written as a
maximum of shift minus distance, a round is one join and one partially aggregated maximum, and idle
rounds in which no cluster has started vanish.  Growth stops after ``rounds`` hops, which bounds the
diameter; whatever is not reached by then stays a cluster of its own.  Clusters contract to
super-vertices, edges inside them vanish, parallel ones merge, and the rest recurses: the number of
edges falls geometrically.  Assignments compose from the smallest level back to the first.

Scale: edges are the only large table and are rewritten, smaller, at each level in the shared
folder.  Joins on a vertex salt the heavy ones (a hub with a third of all edges, a cluster with a
third of all vertices).  Nothing is collected but each level's edge count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import replicated, salted
from ..session import Scratch, table

#: Rate of the exponential shifts (the smaller, the larger the clusters) and hops a level.
BETA, ROUNDS, MOST_LEVELS = 0.2, 4, 60


def _shift(node: Column, level: int, beta: float) -> Column:
    """An exponential shift in millionths of a hop, from a hash of name and level."""
    u = (F.pmod(F.xxhash64(F.lit(level), node), F.lit(1 << 30)) + F.lit(1)) / F.lit(float(1 << 30) + 1)
    return (F.lit(-1e6 / beta) * F.log(u)).cast("long")


def _decompose(edges: DataFrame, level: int, total: int, beta: float, rounds: int) -> DataFrame:
    """``node, center`` of one decomposition."""
    ends = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.v")
    adj = both.unionByName(both.select("u").distinct().select("u", F.col("u").alias("v")))
    adj, heavy = salted(adj, "u", "v", 2 * total)
    state = both.select("u").distinct().select("u", F.struct(_shift(F.col("u"), level, beta).alias("t"), F.col("u").alias("center")).alias("s"))
    for _ in range(rounds):
        hop = F.when(F.col("u") == F.col("v"), 0).otherwise(1_000_000)
        told = adj.join(replicated(state, "u", heavy), ["u", "_salt"]).select(F.col("v").alias("u"), F.struct((F.col("s.t") - hop).alias("t"), F.col("s.center").alias("center")).alias("s"))
        state = told.groupBy("u").agg(F.max("s").alias("s"))
    return state.select(F.col("u").alias("node"), F.col("s.center").alias("center"))


def components(edges: DataFrame, scratch: Scratch, beta: float = BETA, rounds: int = ROUNDS) -> DataFrame:
    """``node, root`` of every vertex of ``edges`` (``u``, ``v``, strings); equal roots mean connected.

    Loops and repeated or reversed edges change nothing; edges with a null end are left out; no
    edges give an empty table.
    """
    canon = lambda d: d.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = scratch.save(canon(edges), "edges0")
    maps: list[DataFrame] = []
    total = now.count()
    while total:
        level = len(maps)
        if level == MOST_LEVELS:
            raise RuntimeError(f"{total} edges are left after {level} levels")
        step = scratch.save(_decompose(now, level, total, beta, rounds), f"map{level}")
        maps.append(step)
        moved = now
        for end in ("u", "v"):
            rows, heavy = salted(moved, end, "v" if end == "u" else "u", total)
            moved = rows.join(replicated(step.select(F.col("node").alias(end), "center"), end, heavy), [end, "_salt"]).drop(end, "_salt").withColumnRenamed("center", end)
        now = scratch.save(canon(moved.select("u", "v")), f"edges{level + 1}")
        scratch.drop(f"edges{level}")
        total = now.count()
    if not maps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1].withColumnRenamed("center", "root")
    for level in range(len(maps) - 2, -1, -1):
        rows, heavy = salted(maps[level], "center", "node", maps[level].count())
        onward = replicated(out.withColumnRenamed("node", "center"), "center", heavy)
        joined = rows.join(onward, ["center", "_salt"], "left").select("node", F.coalesce("root", "center").alias("root"))
        out = scratch.save(joined, f"roots{level}")
        scratch.drop(f"roots{level + 1}")
        scratch.drop(f"map{level + 1}")
    return out


def identifier(c: Column) -> Column:
    """Trimmed, upper case; null for what has no digit and so is no identifier."""
    name = spelled(c)
    return F.when(name.rlike("[0-9]"), name)


def spelled(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def advisory_groups(advisories: DataFrame, scratch: Scratch) -> DataFrame:
    """``advisory_id, group_id``: the smallest advisory id of everything an advisory is linked to.

    Rows of one id are one advisory; ids without a digit, null or unrecorded names, empty or null
    arrays link nothing; an advisory that nothing links is its own group; a null id has no row.
    """
    own = advisories.select(F.col("id").alias("i"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("related", F.array().cast("array<string>"))).alias("names"))
    links = own.select(identifier(F.col("i")).alias("u"), F.explode("names").alias("n")).select("u", identifier(F.col("n")).alias("v")).filter("u is not null and v is not null")
    roots = components(links, scratch)
    ids = own.select(spelled(F.col("i")).alias("advisory_id")).filter("advisory_id is not null").distinct()
    rooted = scratch.save(ids.join(roots, ids.advisory_id == roots.node, "left").select("advisory_id", F.coalesce("root", "advisory_id").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("advisory_id").alias("group_id"))
    rows, heavy = salted(rooted, "root", "advisory_id", rooted.count())
    return rows.join(replicated(least, "root", heavy), ["root", "_salt"]).select("advisory_id", "group_id")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return advisory_groups(table(spark, sf_dir, "advisories").select("id", "aliases", "related"), Scratch(spark, "groups"))
