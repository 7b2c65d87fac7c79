"""Graphs as node and edge tables: neighbours, impact, paths, reachability.

Traversals are loops of joins over an adjacency table written once, with heavy nodes salted.  A frontier is joined with the edges, what was visited is removed by
an anti join, and each round is written to the shared folder, so no plan grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch
from . import skew
from .skew import replicated, salted


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (node, neighbour, edge), followed out, in or both ways."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.col("id").alias("edge"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.col("id").alias("edge"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


class _Adjacency:
    """Edges written once, heavy nodes salted: a hub's edges are spread, and only its row of a frontier is repeated."""

    def __init__(self, pairs: DataFrame, scratch: Scratch):
        kept = scratch.save(pairs, "pairs")
        total = kept.count()
        # Only nodes that may be heavy are kept of the counts, so each round adds its salts from a tiny table.
        counts = None
        if total >= skew.LEAST_ROWS:
            counts = scratch.save(kept.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > total // skew.SHARE), "counts")
        self.rows, self.heavy = salted(kept, "node", "neighbour", total, counts)

    def step(self, frontier: DataFrame) -> DataFrame:
        return replicated(frontier, "node", self.heavy).join(self.rows, ["node", "_salt"]).drop("_salt")


def impact(edges: DataFrame, start: DataFrame, depth: int, scratch: Scratch, direction: str = "out", most: int | None = None) -> DataFrame:
    """``node, distance`` of everything within ``depth`` hops of ``start`` (``node``).

    ``most`` keeps the first nodes by (distance, node), start included.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth is 0 to 6")
    adj = _Adjacency(neighbours(edges, direction).select("node", "neighbour").distinct(), scratch)
    seen = scratch.save(start.select("node", F.lit(0).alias("distance")).distinct(), "d0")
    frontier = seen
    for hop in range(1, depth + 1):
        reached = adj.step(frontier.select("node")).select(F.col("neighbour").alias("node")).distinct()
        fresh = scratch.save(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(hop)), f"d{hop}")
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen if most is None else seen.orderBy("distance", "node").limit(most)


def traversed_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges that a traversal of ``depth`` follows: out of every node nearer than ``depth``."""
    return edges.join(reached.filter(F.col("distance") < depth).select(F.col("node").alias("src")), "src", "left_semi")


def shortest_path(edges: DataFrame, source: str, target: str, scratch: Scratch, most: int = 32) -> DataFrame:
    """``step, node`` of the shortest path; of equal ones the least by node, then edge, at every step.

    Empty if there is none within ``most`` hops.  Every visited node keeps its least predecessor; the
    path is read back from the table of each hop, one row from one small table a step.
    """
    spark = edges.sparkSession
    adj = _Adjacency(neighbours(edges), scratch)
    seen = scratch.save(spark.createDataFrame([(source, None)], "node string, parent string"), "p0")
    hops = [seen]
    found = source == target
    while not found and len(hops) <= most:
        told = adj.step(hops[-1].select("node")).groupBy("neighbour").agg(F.min(F.struct("node", "edge")).alias("m")).select(F.col("neighbour").alias("node"), F.col("m.node").alias("parent"))
        fresh = scratch.save(told.join(seen, "node", "left_anti"), f"p{len(hops)}")
        if fresh.isEmpty():
            break
        found = not fresh.filter(F.col("node") == target).isEmpty()
        seen = seen.unionByName(fresh)
        hops.append(fresh)
    path = [target] if found else []
    for table in reversed(hops[1:] if found else []):
        path.append(table.filter(F.col("node") == path[-1]).select("parent").first()[0])
    return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], "step int, node string")


def reachable(edges: DataFrame, roots: DataFrame, scratch: Scratch, witness: bool = False) -> DataFrame:
    """``node, distance`` of the whole closure from ``roots``, however deep, cycles included.

    ``witness`` adds ``parent``, the least node of the hop before that leads there (null at a root): the
    parents of a node are a path to it from a root.
    """
    adj = _Adjacency(neighbours(edges).select("node", "neighbour").distinct(), scratch)
    start = roots.select("node", F.lit(0).alias("distance")).distinct()
    seen = scratch.save(start.withColumn("parent", F.lit(None).cast("string")) if witness else start, "r0")
    frontier, hop = seen, 0
    while True:
        hop += 1
        told = adj.step(frontier.select("node"))
        reached = told.groupBy("neighbour").agg(F.min("node").alias("parent")).withColumnRenamed("neighbour", "node") if witness else told.select(F.col("neighbour").alias("node")).distinct()
        fresh = reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(hop))
        frontier = scratch.save(fresh.select(seen.columns), f"r{hop}")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = scratch.save(seen, f"all{hop}")


#: Annotations by which a framework enters code.
ROOT_ANNOTATIONS = [
    "SpringBootApplication", "Configuration", "Component", "Service", "Repository", "Controller", "RestController", "Bean", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping",
    "Scheduled", "EventListener", "KafkaListener", "JmsListener", "RabbitListener",
]


def root_kind(language: Column, name: Column, annotations: Column) -> Column:
    """How a declaration is entered from outside - main, initializer or a framework's annotation - or null."""
    low = F.lower(language)
    by_framework = F.array_min(F.array_intersect(annotations, F.array(*[F.lit(a) for a in ROOT_ANNOTATIONS])))
    return F.when((name == "main") & low.isin("go", "java", "kotlin"), "main").when((name == "init") & (low == "go"), "initializer").otherwise(by_framework)


def reach_edges(relations: DataFrame) -> DataFrame:
    """Relations (``source``, ``target``, ``kind``) as edges in the direction in which code is reached.

    Whoever reaches a base reaches what extends or implements it, so these edges turn around; imports and
    loops lead nowhere; parallel edges of one kind merge.
    """
    flip = F.col("kind").isin("implements", "extends")
    turned = relations.filter("kind <> 'import'").select(F.when(flip, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("dst"), "kind")
    return turned.filter("src <> dst").distinct().withColumn("id", F.concat_ws(">", "src", "dst", "kind"))


def verdicts(symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Conservative states: unreachable only where the evidence is complete and the symbol is private.

    ``symbols``: node, private, complete; ``reached``: node.
    """
    hit = reached.select("node").distinct().withColumn("_hit", F.lit(True))
    state = F.when(F.col("_hit"), "reachable").when(~F.col("complete"), "unknown").when(F.col("private"), "probably_unreachable").otherwise("public")
    return symbols.join(hit, "node", "left").withColumn("state", state).drop("_hit")


def summary(states: DataFrame) -> DataFrame:
    """One row: how many symbols have which state."""
    return states.agg(F.count("*").alias("symbols"), *[F.count_if(F.col("state") == s).alias(s) for s in ("reachable", "probably_unreachable", "public", "unknown")])


def resolve_selector(nodes: DataFrame, selector: str) -> str:
    """The one node a selector names: by id, else by label or path, else by part of a label."""
    low = selector.strip().lower()
    tries = [F.col("id") == selector, (F.lower("label") == low) | (F.lower("path") == low), F.contains(F.lower("label"), F.lit(low))]
    for cond in tries:
        hits = [r[0] for r in nodes.filter(cond).select("id").distinct().limit(2).collect()]
        if len(hits) == 1:
            return hits[0]
        if hits:
            raise ValueError(f"{selector!r} names several nodes")
    raise ValueError(f"{selector!r} names no node")


def tightest_container(points: DataFrame, spans: DataFrame, key: list[str], at: str) -> DataFrame:
    """The smallest span (``lo``, ``hi``, ``name``) of the same key that holds each point.

    Spans are cut to blocks of 64 lines, so the join has an equi-key (key, block) and the range test is
    a residual on a bounded neighbourhood.
    """
    blocks = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    hit = points.withColumn("_b", F.floor(F.col(at) / 64)).join(blocks, [*key, "_b"]).filter((F.col("lo") <= F.col(at)) & (F.col(at) <= F.col("hi")))
    return hit.groupBy(*key, at).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), F.col("name"))).alias("m")).select(*key, at, F.col("m.name").alias("name"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: high confidence replaces low, evidence of the winning rank is counted."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    ranked = edges.withColumn("_r", rank)
    return ranked.groupBy("src", "dst", "kind", "_r").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).groupBy("src", "dst", "kind").agg(F.max(F.struct("_r", "c", "n")).alias("m")).select("src", "dst", "kind", F.col("m.c").alias("confidence"), F.col("m.n").alias("evidence"))


def merge_evidence(rows: DataFrame, key: list[str], evidence: str, most: int = 12) -> DataFrame:
    """Distinct evidence of each key in order, at most ``most``, with how many there are in all.

    Pieces are ranked and cut before they are brought together, so no key collects more than it shows.
    """
    distinct = rows.select(*key, evidence).distinct()
    total = distinct.groupBy(*key).agg(F.count("*").alias("total"))
    top = distinct.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(evidence))).filter(F.col("_n") <= most)
    return top.groupBy(*key).agg(F.array_sort(F.collect_list(evidence)).alias(evidence)).join(total, key)


def snapshot_graph(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, kind, label``) and edges (``src, dst, kind, id``) of repositories, their files and what these declare.

    ``files``: repository_id, repository, path; ``symbols``: repository, path, kind, name.
    """
    repo, file = F.concat(F.lit("repository:"), "repository"), F.concat_ws(":", F.lit("file"), "repository", "path")
    symbol = F.concat_ws(":", F.lit("symbol"), "repository", "path", "kind", "name")
    nodes = files.select(repo.alias("id"), F.lit("repository").alias("kind"), F.col("repository").alias("label")).distinct()
    nodes = nodes.unionByName(files.select(file.alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label")).distinct()).unionByName(symbols.select(symbol.alias("id"), F.lit("symbol").alias("kind"), F.col("name").alias("label")).distinct())
    edges = files.select(repo.alias("src"), file.alias("dst"), F.lit("contains").alias("kind")).distinct().unionByName(symbols.select(file.alias("src"), symbol.alias("dst"), F.lit("defines").alias("kind")).distinct())
    return nodes, edges.withColumn("id", F.concat_ws(">", "src", "dst"))
