"""Insights, dependencies, topology, graphs, reports and table maintenance over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions
from ..functions.scalars import language_of, service_name
from ..operators import dependencies, graph, insights, store, topology
from ..session import Scratch, shared_dir, table
from ..sources import reports
from ..streaming import monitors


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# ---------------------------------------------------------------- insights
def _obs(spark, sf_dir: str, *columns: str, where: str | Column | None = None) -> DataFrame:
    """Observations once each: filtered and projected first, so that only what a query reads is shuffled."""
    rows = _t(spark, sf_dir, "insight_observations")
    return (rows if where is None else rows.filter(where)).select(*dict.fromkeys(["id", *columns])).distinct()


IDENTITY = ["repository_id", "tool", "branch", "kind", "key", "path"]


def insight_current_history(spark, sf_dir):
    rows = insights.current_and_history(_obs(spark, sf_dir, *IDENTITY, "observed_at"), IDENTITY, [F.desc("observed_at"), F.desc("id")])
    return rows.select("id", "place")


def insight_latest_metrics(spark, sf_dir):
    m = _obs(spark, sf_dir, "repository_id", "key", "path", "observed_at", "value", "unit", where="kind = 'metric' and state <> 'quarantined'")
    return insights.latest(m, ["repository_id", "key", "path"], "observed_at", "id", ["value", "unit"]).withColumn("value", F.round("value", 6))


def insight_facets(spark, sf_dir):
    from ..operators.search import facets

    fields = ["kind", "tool", "severity", "language", "owner", "state", "confidence", "branch"]
    return facets(_obs(spark, sf_dir, *fields), fields)


def insight_filter(spark, sf_dir):
    return _obs(spark, sf_dir, "repository_id", "path", where=(F.lower("tool") == "secscan") & F.lower("severity").isin("error", "high", "critical") & F.col("path").like("internal/%") & (F.col("observed_at") >= F.lit("2025-03-01").cast("timestamp_ntz")) & (F.col("observed_at") < F.lit("2025-10-01").cast("timestamp_ntz")) & (F.col("state") != "quarantined"))


def insight_compare_metrics(spark, sf_dir):
    m = _obs(spark, sf_dir, "repository_id", "key", "path", "observed_at", "value", where="kind = 'metric' and value is not null").select("repository_id", "key", "path", F.month("observed_at").alias("m"), "value", "id")
    half = lambda lo, hi: m.filter(F.col("m").between(lo, hi)).groupBy("repository_id", "key", "path").agg(F.max_by("value", "id").alias("value"))
    out = insights.compare_metrics(half(1, 6), half(7, 12), ["repository_id", "key", "path"])
    return out.withColumn("from_value", F.round("from_value", 6)).withColumn("to_value", F.round("to_value", 6))


def insight_introduced_resolved(spark, sf_dir):
    # Both sides become sets of keys, so what was delivered twice needs no pass of its own.
    f = _t(spark, sf_dir, "insight_observations").filter("kind = 'finding'").select("repository_id", F.col("key"), F.coalesce("path", F.lit("")).alias("path"), F.month("observed_at").alias("m"))
    return insights.introduced_resolved(f.filter("m <= 6"), f.filter("m > 6"), ["repository_id", "key", "path"])


BOUNDS = [("coverage.line", "lt", 60.0, "error"), ("coverage.line", "lte", 80.0, "warning"), ("complexity", "gt", 20.0, "warning"), ("duplication", "gte", 5.0, "note")]


def threshold_evaluation(spark, sf_dir):
    m = insights.latest(_t(spark, sf_dir, "insight_observations").filter("kind = 'metric'"), ["repository_id", "key"], "observed_at", "id", ["value"]).withColumnRenamed("key", "metric")
    marks = spark.createDataFrame(BOUNDS, "metric string, operator string, bound double, severity string")
    every = m.select("metric").distinct().join(marks.select("operator", "bound", "severity").distinct())  # a handful of metric names
    return insights.evaluate(m, every).select("repository_id", "metric", "operator", "bound", "severity", "breached")


def retention_keep_n(spark, sf_dir):
    runs = _t(spark, sf_dir, "insight_observations").groupBy("repository_id", "tool", "branch", "run_id").agg(F.max("observed_at").alias("at"))
    return insights.keep_newest(runs, ["repository_id", "tool", "branch"], [F.desc("at"), F.desc("run_id")], 3).select("repository_id", "tool", "branch", "run_id")


def derived_metrics_rollup(spark, sf_dir):
    files = _t(spark, sf_dir, "source_files")
    return insights.metric_rollup(insights.file_metrics(files))


def path_reconcile(spark, sf_dir):
    raw = _t(spark, sf_dir, "insight_observations").filter("path is not null").select("repository_id", "path").distinct()
    reported = raw.select("repository_id", F.concat(F.lit("file:///build/"), F.upper("path")).alias("raw"))
    return insights.suffix_reconcile(reported, raw)


# ---------------------------------------------------------------- coverage and reports
def _counts(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey", F.col("l_returnflag").alias("path")).agg(F.count("*").cast("double").alias("lines_found"), F.count_if(F.col("l_quantity") > 20).cast("double").alias("lines_hit"), F.count_if(F.col("l_linestatus") == "O").cast("double").alias("branches_found"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.03)).cast("double").alias("branches_hit"))


def coverage_metrics(spark, sf_dir):
    return reports.coverage_metrics(_counts(spark, sf_dir), ["l_suppkey", "path"])


def coverage_aggregate(spark, sf_dir):
    return reports.coverage_metrics(reports.coverage_total(_counts(spark, sf_dir), ["l_suppkey"]), ["l_suppkey", "path"])


def lcov_import(spark, sf_dir):
    """LCOV texts made of the counts of each supplier, read back."""
    c = _counts(spark, sf_dir)
    n = lambda x: F.col(x).cast("long").cast("string")
    one = F.concat(F.lit("SF:"), "path", F.lit("\nLF:"), n("lines_found"), F.lit("\nLH:"), n("lines_hit"), F.lit("\nBRF:"), n("branches_found"), F.lit("\nBRH:"), n("branches_hit"), F.lit("\nend_of_record\n"))
    texts = c.select(F.col("l_suppkey").alias("report_id"), "path", one.alias("one")).groupBy("report_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("path", "one"))), lambda x: x["one"])).alias("text"))
    return reports.lcov(texts).select("report_id", "path", "lines_found", "lines_hit", "branches_found", "branches_hit")


def sarif_findings(spark, sf_dir):
    texts = _t(spark, sf_dir, "sarif_reports").select("report_id", "text").distinct()
    return reports.sarif(texts).select("report_id", F.col("run_no").cast("long"), F.col("result_no").cast("long"), "key", "severity", "path", F.col("start_line").cast("long"))


def sarif_export(spark, sf_dir):
    f = _obs(spark, sf_dir, "repository_id", "key", "severity", "path", "start_line", where="kind = 'finding' and state = 'current' and repository_id is not null")
    page = f.select("id", "repository_id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("severity", F.lit("")).alias("severity"), F.concat(F.lit("finding "), F.col("id").cast("string")).alias("message"), F.coalesce("path", F.lit("")).alias("path"), "start_line")
    logs = reports.to_sarif(page, ["key", "path", "start_line", "id"])
    # What was exported, read back.
    return reports.sarif(logs.withColumnRenamed("repository_id", "report_id")).select(F.col("report_id").alias("repository_id"), F.col("result_no").cast("long").alias("nth"), "key", F.col("severity").alias("level"), "message", "path", F.col("start_line").cast("long").alias("start_line"))


# ---------------------------------------------------------------- dependencies
def _declarations(spark, sf_dir) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    v = F.concat_ws(".", F.col("l_partkey") % 4, F.col("l_partkey") % 7, (F.col("l_partkey") + F.col("l_suppkey")) % 5)
    pre = F.when(F.col("l_partkey") % 11 == 0, F.concat(v, F.lit("-rc.1"))).otherwise(v)
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("repository"), F.lower("p_brand").alias("ecosystem"), "l_partkey", F.col("p_name").alias("package"), pre.alias("version"), (F.col("l_returnflag") != "R").alias("exact"), F.col("l_returnflag").alias("usage"))


def _registry(spark, sf_dir) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_partkey % 6 <> 0")
    best = F.max(F.struct((F.col("p_partkey") % 4).alias("a"), (F.col("p_partkey") % 5).alias("b"), (F.col("p_partkey") % 3).alias("c"))).alias("m")
    return p.groupBy(F.lower("p_brand").alias("ecosystem"), F.col("p_name").alias("package")).agg(best).select("ecosystem", "package", F.concat_ws(".", "m.a", "m.b", "m.c").alias("latest"))


def dependency_inventory(spark, sf_dir):
    inv = dependencies.inventory(_declarations(spark, sf_dir), _registry(spark, sf_dir))
    return inv.select("repository", "l_partkey", "usage", "version", "latest", "status", "distance")


def dependency_status_counts(spark, sf_dir):
    return dependencies.status_counts(dependencies.inventory(_declarations(spark, sf_dir), _registry(spark, sf_dir)))


def dependency_search(spark, sf_dir):
    d = _declarations(spark, sf_dir)
    hay = F.lower(F.concat_ws("\n", "repository", "ecosystem", "package", "version", "usage"))
    return d.filter(F.contains(hay, F.lit("brand#2")) & (F.lower("usage") == "r")).select("repository", "l_partkey")


ROUTES = [("", "public"), ("a", "mirror-a"), ("al", "mirror-al"), ("la", "private-la"), ("part", "parts"), ("lav", "lavender"), ("b", "mirror-b")]


def registry_longest_prefix(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    routes = spark.createDataFrame(ROUTES, "prefix string, registry string")
    return dependencies.longest_prefix(names, "name", routes).select("p_partkey", "registry")


def advisory_range_join(spark, sf_dir):
    """Declarations made of the advisories' own packages against every advisory's ranges and versions."""
    adv = _t(spark, sf_dir, "advisories")
    e = adv.select("record_id", F.explode("affected").alias("f")).filter("f is not null and f.ecosystem is not null and f.name is not null")
    v = F.concat_ws(".", F.col("record_id") % 13, F.col("record_id") % 31, F.col("record_id") % 17)
    decl = e.select(F.col("f.ecosystem").alias("ecosystem"), F.col("f.name").alias("package"), v.alias("version")).distinct()
    return dependencies.match_advisories(decl, adv).select("record_id", "ecosystem", "package", "version", "fixed").distinct()


def advisory_gaps(spark, sf_dir):
    """Advisory entries whose package nobody declares."""
    e = _t(spark, sf_dir, "advisories").select("record_id", F.explode("affected").alias("f")).filter("f.name is not null").select("record_id", F.lower("f.ecosystem").alias("ecosystem"), F.lower("f.name").alias("package")).distinct()
    declared = e.filter("record_id % 3 = 0").select("ecosystem", "package").distinct()
    return e.join(declared, ["ecosystem", "package"], "left_anti")


def advisory_severities(spark, sf_dir):
    a = _t(spark, sf_dir, "advisories")
    return a.select("record_id", dependencies.advisory_severity(F.col("severity")).alias("band"))


def _findings(spark, sf_dir) -> DataFrame:
    f = _obs(spark, sf_dir, "tool", "key", "repository_id", "language", "branch", "path", "start_line", "severity", where="kind = 'finding' and path is not null")
    usage = F.when(F.col("tool") == "secscan", 0).when(F.col("tool") == "depaudit", 1).otherwise(2)
    return f.select(F.col("key").alias("advisory"), F.col("repository_id").alias("repository"), F.coalesce("language", F.lit("")).alias("package"), F.coalesce("branch", F.lit("")).alias("version"), usage.alias("usage_rank"), "path", F.coalesce("start_line", F.lit(0)).alias("line"), F.coalesce("severity", F.lit("")).alias("relationship"), F.coalesce("severity", F.lit("")).alias("severity"), "tool")


def finding_dedup(spark, sf_dir):
    return dependencies.dedupe_findings(_findings(spark, sf_dir)).withColumn("primary_line", F.col("primary_line").cast("long"))


def finding_headlines(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity", "tool").agg(F.count("*").alias("findings"), F.count_distinct("repository").alias("repositories"))


def finding_groups(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity", "tool", "repository", "package").agg(F.count("*").alias("findings"))


def snapshot_digest(spark, sf_dir):
    """A digest of each repository's set of file revisions, the same for the same set in any order.

    Lanes of the rows' hashes are combined by exclusive or: mergeable, so no set is ever in one task.
    """
    f = _t(spark, sf_dir, "source_files").select("repository_id", F.md5(F.concat_ws("@", "path", "revision")).alias("h")).distinct()
    lane = lambda k: F.bit_xor(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"lane{k}")
    return f.groupBy("repository_id").agg(F.count("*").alias("n"), *[lane(k) for k in range(4)])


# ---------------------------------------------------------------- topology
def _runtime(spark, sf_dir, once: bool = True) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    o = _t(spark, sf_dir, "runtime_observations")
    return (o.distinct() if once else o).select(service_name(F.coalesce("source_name", F.lit(""))).alias("source"), service_name(F.coalesce("target_name", F.lit(""))).alias("target"), blank("protocol"), blank("environment"), "provider", "request_count", "error_count", "latency_p95_ms", "observed_from", "observed_to").filter("source <> '' and target <> ''")


def topology_runtime_metrics(spark, sf_dir):
    m = topology.merge_runtime(_runtime(spark, sf_dir).withColumnRenamed("environment", "env").withColumn("environment", F.col("env")), ["source", "target", "protocol"])
    return m.select("source", "target", "protocol", F.col("requests").cast("long"), F.col("errors").cast("long"), "p95_ms", "first_seen", "last_seen", "provider", "environment", "error_rate")


def topology_full_outer_merge(spark, sf_dir):
    r = _runtime(spark, sf_dir, once=False)  # only distinct keys matter
    key = ["source", "target", "protocol", "environment"]
    declared = r.filter("provider = 'tracehub'").select("source", "target", "protocol", F.when(F.length("target") % 2 == 0, F.col("environment")).otherwise("").alias("environment"))
    return topology.merge_static_runtime(declared, r.filter("provider <> 'tracehub'"), key)


def topology_alias_unique(spark, sf_dir):
    repos = _t(spark, sf_dir, "repositories")
    comps = repos.select(F.col("id"), F.array("name", "path").alias("aliases"))
    names = _t(spark, sf_dir, "source_files").select(F.concat(F.lit("http://"), F.upper("repository"), F.lit(".svc:80/x")).alias("name")).unionByName(_t(spark, sf_dir, "runtime_observations").select(F.col("source_name").alias("name")).filter("name is not null")).distinct()
    return topology.unique_aliases(names, comps)


def placeholder_top_rank(spark, sf_dir):
    f = _t(spark, sf_dir, "runtime_observations").filter("source_name is not null and environment is not null").select(F.lower(F.trim("source_name")).alias("variable"), "environment", "provider").distinct()
    rank = F.when(F.col("environment") == "production", 3).when(F.col("environment") == "staging", 2).otherwise(1)
    return topology.top_ranked(f.withColumn("rank", rank), ["variable"], "rank").withColumn("rank", F.col("rank").cast("long"))


def neighborhood_cap(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("neighbour")).agg(F.count("*").alias("weight"))
    return topology.cap_neighbours(li, "node", [F.desc("weight"), F.asc("neighbour")], 12, "weight")


def runtime_window_overlap(spark, sf_dir):
    o = topology.overlapping(_t(spark, sf_dir, "runtime_observations").distinct(), "2025-06-01 00:00:00", "2025-06-07 23:59:59")
    return o.groupBy("provider", "environment").agg(F.count("*").alias("n"), F.sum("request_count").alias("requests"))


def component_longest_prefix(spark, sf_dir):
    f = _t(spark, sf_dir, "source_files").select("repository_id", "path").distinct()
    cut = lambda n: f.select("repository_id", F.array_join(F.slice(F.split("path", "/"), 1, n), "/").alias("root"), F.lit(n).alias("component")).filter(F.length("root") % 3 != 0)
    roots = cut(1).unionByName(cut(2)).unionByName(f.select("repository_id").distinct().select("repository_id", F.lit("").alias("root"), F.lit(0).alias("component"))).distinct()
    files = f.filter(F.size(F.split("path", "/")) > 2)
    return topology.longest_root(files, roots).select("repository_id", "path", "root", F.col("depth").cast("long"))


# ---------------------------------------------------------------- graphs
def _edges(spark, sf_dir) -> DataFrame:
    t = lambda n: _t(spark, sf_dir, n)
    e = lambda df, kind, a, ka, b, kb: df.select(F.concat(F.lit(ka + ":"), F.col(a)).alias("src"), F.concat(F.lit(kb + ":"), F.col(b)).alias("dst"), F.lit(kind).alias("kind"))
    parts = [e(t("nation"), "in", "n_nationkey", "nation", "n_regionkey", "region"), e(t("customer"), "in", "c_custkey", "customer", "c_nationkey", "nation"), e(t("supplier"), "in", "s_suppkey", "supplier", "s_nationkey", "nation"), e(t("orders"), "by", "o_orderkey", "order", "o_custkey", "customer"), e(t("lineitem"), "from", "l_orderkey", "order", "l_suppkey", "supplier").distinct()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", F.concat("src", F.lit(">"), "dst"))


def graph_union(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return ends


def graph_neighbors(spark, sf_dir):
    n = graph.neighbours(_edges(spark, sf_dir), "both").filter("node in ('nation:3', 'supplier:7')")
    return n.select("node", "neighbour")


def graph_impact_bfs(spark, sf_dir):
    s = Scratch(spark, "impact")
    return graph.impact(_edges(spark, sf_dir), spark.createDataFrame([("nation:3",)], "node string"), 3, s, "in").withColumn("distance", F.col("distance").cast("long"))


def graph_traversed_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "id")
    hit = graph.impact(e, spark.createDataFrame([("region:1",)], "node string"), 2, Scratch(spark, "edges"), "in")
    return graph.traversed_edges(back, hit, 2).select("id")


def graph_shortest_path(spark, sf_dir):
    e = _edges(spark, sf_dir)
    both = e.select("src", "dst", "id").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id"))
    return graph.shortest_path(both, "customer:1", "region:4", Scratch(spark, "path")).withColumn("step", F.col("step").cast("long"))


def reachability_closure(spark, sf_dir):
    roots = _t(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.concat(F.lit("order:"), "o_orderkey").alias("node"))
    return graph.reachable(_edges(spark, sf_dir), roots, Scratch(spark, "reach")).withColumn("distance", F.col("distance").cast("long"))


def containing_interval_min_span(spark, sf_dir):
    o = _t(spark, sf_dir, "insight_observations").filter("start_line is not null and end_line >= start_line and path is not null")
    spans = o.select("repository_id", "path", F.greatest(F.lit(1), F.col("start_line") - F.col("id") % 40).cast("long").alias("lo"), (F.col("end_line") + F.col("id") % 25).cast("long").alias("hi"), F.col("key").alias("name")).distinct()
    points = o.select("repository_id", "path", F.col("start_line").cast("long").alias("line")).distinct()
    return graph.tightest_container(points, spans, ["repository_id", "path"], "line")


def edge_confidence_merge(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    conf = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    e = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supplies").alias("kind"), conf.alias("confidence"))
    return graph.merge_edges(e)


# ---------------------------------------------------------------- tables
def repository_access_semi(spark, sf_dir):
    grants = _t(spark, sf_dir, "repositories").filter("not bare and scan_state = 'ok'").select(F.col("id").alias("repository_id"))
    return store.visible(_obs(spark, sf_dir, "repository_id"), grants).groupBy("repository_id").agg(F.count("*").alias("n"))


def repository_access_anti(spark, sf_dir):
    repos = _t(spark, sf_dir, "repositories")
    with_rows = _t(spark, sf_dir, "documents").select(F.col("repository_id").alias("id")).distinct()
    return repos.join(with_rows, "id", "left_anti").select("id", "name")


def catalogue_scan(spark, sf_dir):
    r = _t(spark, sf_dir, "repositories")
    n = _t(spark, sf_dir, "source_files").select("repository_id", "file_id").distinct().groupBy("repository_id").agg(F.count("*").alias("files"))
    return r.join(n, r.id == n.repository_id, "left").select("id", "name", F.coalesce("files", F.lit(0)).alias("files"), (F.col("head_commit") == F.col("indexed_commit")).alias("fresh")).orderBy(F.lower("name"), "id")


def catalogue_sync(spark, sf_dir):
    r = _t(spark, sf_dir, "repositories")
    known = r.select("path", F.col("indexed_commit").alias("head"), "discovery_misses", F.col("index_state").alias("state"))
    found = r.filter("id % 4 <> 0").select(F.when(F.col("id") % 10 == 1, F.concat("path", F.lit("-moved"))).otherwise(F.col("path")).alias("path"), F.col("head_commit").alias("head"))
    return store.sync_catalogue(known, found).withColumn("discovery_misses", F.col("discovery_misses").cast("long"))


def upsert_latest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    return store.upsert(old, o.filter("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey")


def audit_keyset_page(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter(F.contains(F.lower(F.concat_ws("\n", "event_type", "props")), F.lit("7")))
    return store.keyset_page(e.select("event_id", "event_type", "user_id"), "event_id", 8000, 100)


def identity_page(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return store.offset_page(c, [F.lower("c_name"), F.asc("c_custkey")], 120, 40)


def output_bound(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.length("o_orderpriority").cast("long").alias("size"))
    return store.bounded_by_size(o, ["o_custkey"], [F.desc("o_orderkey")], F.col("size"), 60).select("o_custkey", "o_orderkey", "truncated")


def conversation_counts(spark, sf_dir):
    m = _t(spark, sf_dir, "conversation_messages").filter("conversation_id is not null").select("conversation_id", "id", "created_at").distinct()
    return m.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def commit_ancestors(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    from pyspark.sql import Window as W

    parent = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    commits = o.select(F.col("o_orderkey").cast("string").alias("revision"), F.when(parent.isNotNull(), F.array(parent.cast("string"))).otherwise(F.array().cast("array<string>")).alias("parents"))
    heads = o.groupBy("o_custkey").agg(F.max("o_orderkey").cast("string").alias("node")).select("node")
    return store.ancestors(commits, heads, Scratch(spark, "ancestors")).withColumn("distance", F.col("distance").cast("long"))


# ---------------------------------------------------------------- incremental
def _runs(spark, sf_dir) -> DataFrame:
    r = _t(spark, sf_dir, "monitor_runs").select("id", "monitor_id", "revision_key", "result_keys_json", "status", "created_at").distinct()
    scope = F.array_join(F.array_sort(F.transform(F.split("revision_key", ","), lambda x: F.regexp_extract(x, "^([^:]*)", 1))), ",")
    return r.select("id", "monitor_id", F.coalesce(scope, F.lit("")).alias("scope"), F.from_json("result_keys_json", "array<string>").alias("keys"), "status", F.col("created_at").cast("timestamp").alias("created_at")).filter("keys is not null")


def monitor_delta(spark, sf_dir):
    changes, _ = monitors.deltas(_runs(spark, sf_dir), None, Scratch(spark, "monitor"))
    return changes.select("monitor_id", "id", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"), "state")


def streaming_monitor(spark, sf_dir):
    """The same changes from a stream of files, in order of time."""
    scratch = Scratch(spark, "stream")
    root = scratch.root
    runs = _runs(spark, sf_dir)
    runs.repartitionByRange(3, "created_at", "id").sortWithinPartitions("created_at", "id").write.mode("overwrite").parquet(f"{root}/source")
    monitors.run_monitors(spark, f"{root}/source", f"{root}/target", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/target/changes").select("monitor_id", "id", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"), "state")


QUERIES = {
    f.__name__: f
    for f in (
        insight_current_history, insight_latest_metrics, insight_facets, insight_filter, insight_compare_metrics, insight_introduced_resolved, threshold_evaluation, retention_keep_n, derived_metrics_rollup, path_reconcile,
        coverage_metrics, coverage_aggregate, lcov_import, sarif_findings, sarif_export, dependency_inventory, dependency_status_counts, dependency_search, registry_longest_prefix, advisory_range_join, advisory_gaps, advisory_severities,
        finding_dedup, finding_headlines, finding_groups, snapshot_digest, topology_runtime_metrics, topology_full_outer_merge, topology_alias_unique, placeholder_top_rank, neighborhood_cap, runtime_window_overlap, component_longest_prefix,
        graph_union, graph_neighbors, graph_impact_bfs, graph_traversed_edges, graph_shortest_path, reachability_closure, containing_interval_min_span, edge_confidence_merge, repository_access_semi, repository_access_anti, catalogue_scan,
        catalogue_sync, upsert_latest, audit_keyset_page, identity_page, output_bound, conversation_counts, commit_ancestors, monitor_delta, streaming_monitor,
    )
}


# ---------------------------------------------------------------- the SQL they are checked against
_O = "o as (select distinct * from insight_observations)"
_COUNTS = """c as (select l_suppkey, l_returnflag as path, cast(count(*) as double) as lf, cast(count(*) filter (l_quantity > 20) as double) as lh,
  cast(count(*) filter (l_linestatus = 'O') as double) as bf, cast(count(*) filter (l_linestatus = 'O' and l_discount > 0.03) as double) as bh from lineitem group by all)"""
_METRICS = """select l_suppkey, path, u.metric, u.value, case when u.value is null then 'skipped' else 'measured' end as state from (select *, unnest([
  {'metric': 'coverage.lines.covered', 'value': lh}, {'metric': 'coverage.lines.total', 'value': lf}, {'metric': 'coverage.line', 'value': case when lf > 0 then round(100 * lh / lf, 6) end},
  {'metric': 'coverage.branches.covered', 'value': bh}, {'metric': 'coverage.branches.total', 'value': bf}, {'metric': 'coverage.branch', 'value': case when bf > 0 then round(100 * bh / bf, 6) end}]) as u from %s)"""
_DECL = """d as (select l_suppkey as repository, lower(p_brand) as ecosystem, l_partkey, p_name as package, (l_partkey % 4) || '.' || (l_partkey % 7) || '.' || ((l_partkey + l_suppkey) % 5) || case when l_partkey % 11 = 0 then '-rc.1' else '' end as version,
  l_returnflag <> 'R' as exact, l_returnflag as usage from (select distinct l_suppkey, l_partkey, l_returnflag from lineitem) join part on l_partkey = p_partkey)"""
_INV = (
    _DECL
    + """, g as (select lower(p_brand) as ecosystem, p_name as package, max([p_partkey % 4, p_partkey % 5, p_partkey % 3]) as m from part where p_partkey % 6 <> 0 group by all),
r as (select ecosystem, package, m[1] || '.' || m[2] || '.' || m[3] as latest from g),
i as (select d.*, r.latest, list_transform(string_split(regexp_extract(d.version, '^[0-9.]+'), '.'), lambda x: cast(x as bigint)) as a, list_transform(string_split(r.latest, '.'), lambda x: cast(x as bigint)) as b from d left join r using (ecosystem, package)),
s as (select *, case when latest is null then 'unavailable' when not exact then 'unresolved' when version = latest then 'current' when version like '%-rc%' then 'prerelease' when a > b then 'ahead' else 'behind' end as status from i)"""
)
_FIND = """f as (select key as advisory, repository_id as repository, coalesce(language, '') as package, coalesce(branch, '') as version, case tool when 'secscan' then 0 when 'depaudit' then 1 else 2 end as usage_rank, path,
  coalesce(start_line, 0) as line, coalesce(severity, '') as relationship, coalesce(severity, '') as severity, tool from o where kind = 'finding' and path is not null)"""
_SERVICE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^http://', ''), '^https://', ''), '^lb://', ''), '/.*$', '', 's'), ':.*$', '', 's'), '\..*$', '', 's'), '[_ ]', '-', 'g'), '^-+|-+$', '', 'g')"
_RUN = f"""q as (select {_SERVICE.format("coalesce(source_name, '')")} as source, {_SERVICE.format("coalesce(target_name, '')")} as target, coalesce(protocol, '') as protocol, coalesce(environment, '') as environment,
  provider, request_count, error_count, latency_p95_ms, observed_from, observed_to from (select distinct * from runtime_observations)), rt as (select * from q where source <> '' and target <> '')"""
_EDGES = """e as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'in' as kind from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in' from supplier union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'by' from orders
  union all select distinct 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'from' from lineitem)"""
_MONITOR = """m as (select distinct id, monitor_id, coalesce(array_to_string(list_sort(list_transform(string_split(revision_key, ','), lambda x: regexp_extract(x, '^([^:]*)', 1))), ','), '') as scope,
  case when json_valid(result_keys_json) and json_type(result_keys_json) = 'ARRAY' then cast(json_extract(result_keys_json, '$') as varchar[]) end as keys, created_at from monitor_runs where status = 'complete'),
w as (select *, lag(keys) over p as k, lag(scope) over p as s from m where keys is not null window p as (partition by monitor_id order by created_at, id))
select monitor_id, id, case when s = scope then cast(len(list_filter(list_distinct(keys), lambda x: not list_contains(k, x))) as bigint) else 0 end as added,
  case when s = scope then cast(len(list_filter(list_distinct(k), lambda x: not list_contains(keys, x))) as bigint) else 0 end as removed, case when s = scope then 'complete' else 'incomplete' end as state from w where s is not null"""
_PKG = "case when lower(ecosystem) = 'pypi' then regexp_replace(lower(trim(package)), '[-_.]+', '-', 'g') when lower(ecosystem) in ('npm', 'nuget') then lower(trim(package)) else trim(package) end"
_LANG = "case regexp_extract(lower(path), '\\.([^./]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in (("go", "Go"), ("js", "JavaScript"), ("java", "Java"), ("py", "Python"))) + " else '' end"


def version_sql(eco: str, v: str) -> str:
    """SQL for the sort key of versions ``a.b.c`` with a leading v, ``-beta.n``, ``-rcn`` or ``.Final``."""
    part = lambda i: f"lpad(regexp_extract({v}, '([0-9]+)\\.([0-9]+)\\.([0-9]+)', {i}), 12, '0')"
    core = " || ".join(part(i) for i in (1, 2, 3))
    tail = f"lpad(regexp_extract({v}, '-(?:beta\\.|rc)([0-9]+)$', 1), 12, '0')"
    kind = lambda beta, rc, rest: f"case when contains({v}, '-beta.') then '{beta}' || {tail} when contains({v}, '-rc') then {rc} else '{rest}' end"
    plain, text = lambda n: f"'{n}' || {tail}", f"'2' || regexp_extract({v}, '-(rc.*)$', 1)"
    return f"""case when lower({eco}) = 'maven' and starts_with(lower(trim({v})), 'v') then ' ' || {part(1)} when lower({eco}) = 'maven' then {core} || {kind(2, plain(4), 6)}
  when lower({eco}) = 'pypi' then {core} || {kind(2, plain(3), 4)} else {core} || {kind(1, text, 9)} end"""


def _branches(tokens: list[str]) -> str:
    return " + ".join(f"(length(j) - length(replace(j, '{t}', ''))) // {len(t)}" for t in tokens)


def _branch_sql() -> str:
    from ..functions.scalars import BRANCHES

    return f"case language when 'Python' then {_branches(BRANCHES['Python'])} when 'Go' then {_branches(BRANCHES['Go'])} else {_branches(BRANCHES[''])} end"


ORACLES = {
    "insight_current_history": f"with {_O} select id, case when row_number() over (partition by repository_id, tool, branch, kind, key, path order by observed_at desc, id desc) = 1 then 'current' else 'history' end as place from o",
    "insight_latest_metrics": f"with {_O} select repository_id, key, path, round(value, 6) as value, unit from o where kind = 'metric' and state <> 'quarantined' qualify row_number() over (partition by repository_id, key, path order by observed_at desc, id desc) = 1",
    "insight_facets": f"with {_O} " + " union all ".join(f"select '{c}' as field, {c} as value, count(*) as count from o where {c} <> '' group by {c}" for c in ("kind", "tool", "severity", "language", "owner", "state", "confidence", "branch")),
    "insight_filter": f"with {_O} select id, repository_id, path from o where lower(tool) = 'secscan' and lower(severity) in ('error', 'high', 'critical') and path like 'internal/%' and observed_at >= timestamp '2025-03-01' and observed_at < timestamp '2025-10-01' and state <> 'quarantined'",
    "insight_compare_metrics": f"""with {_O}, m as (select repository_id, key, path, month(observed_at) as m, value, id from o where kind = 'metric' and value is not null),
a as (select repository_id, key, path, arg_max(value, id) as value from m where m <= 6 group by all), b as (select repository_id, key, path, arg_max(value, id) as value from m where m > 6 group by all)
select coalesce(a.repository_id, b.repository_id) as repository_id, coalesce(a.key, b.key) as key, coalesce(a.path, b.path) as path, round(a.value, 6) as from_value, round(b.value, 6) as to_value, round(b.value - a.value, 6) as delta,
  case when a.value is null then 'added' when b.value is null then 'removed' when a.value = b.value then 'same' else 'changed' end as state
from a full join b on a.repository_id is not distinct from b.repository_id and a.key is not distinct from b.key and a.path is not distinct from b.path""",
    "insight_introduced_resolved": f"""with {_O}, f as (select distinct repository_id, key, coalesce(path, '') as path, month(observed_at) <= 6 as early from o where kind = 'finding')
select repository_id, key, path, case when bool_or(early) then 'resolved' else 'introduced' end as change from f group by repository_id, key, path having bool_and(early) or not bool_or(early)""",
    "threshold_evaluation": f"""with {_O}, m as (select repository_id, key as metric, value from o where kind = 'metric' qualify row_number() over (partition by repository_id, key order by observed_at desc, id desc) = 1),
t(operator, bound, severity) as (values ('lt', 60.0::double, 'error'), ('lte', 80.0, 'warning'), ('gt', 20.0, 'warning'), ('gte', 5.0, 'note'))
select repository_id, metric, operator, bound, severity, coalesce(case operator when 'lt' then value < bound when 'lte' then value <= bound when 'gt' then value > bound else value >= bound end, false) as breached from m, t""",
    "retention_keep_n": f"with {_O}, r as (select repository_id, tool, branch, run_id, max(observed_at) as seen from o group by all) select repository_id, tool, branch, run_id from r qualify row_number() over (partition by repository_id, tool, branch order by seen desc, run_id desc) <= 3",
    "derived_metrics_rollup": f"""with s as (select distinct on (file_id) repository_id, path, {_LANG} as language, replace(content, chr(13) || chr(10), chr(10)) as t from source_files where content is not null),
u as (select *, string_split(case when ends_with(t, chr(10)) then t[:-2] else t end, chr(10)) as a, array_to_string(list_transform(string_split(lower(t), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)) as j from s where language <> ''),
v as (select repository_id, path, language, case when length(t) = 0 then 0 else len(a) end as lines, len(list_filter(a, lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) as nonblank, {_branch_sql()} as branches from u)
select repository_id, language, path, cast(sum(lines) as bigint) as lines, cast(sum(nonblank) as bigint) as nonblank, cast(sum(branches) as bigint) as branches, count(*) as files,
  case when grouping(path) = 0 then 'file' when grouping(language) = 0 then 'language' else 'repository' end as level from v group by grouping sets ((repository_id, language, path), (repository_id, language), (repository_id))""",
    "path_reconcile": """with p as (select distinct repository_id, path from insight_observations where path is not null),
w as (select distinct repository_id, 'file:///build/' || upper(path) as raw, lower(path) as low from p),
h as (select w.repository_id, w.raw, count(*) as n, min(p.path) as path from w join p on w.repository_id = p.repository_id and lower(p.path) = w.low group by all)
select repository_id, raw, case when n = 1 then path end as path, case when n = 1 then 'suffix' else 'unresolved' end as state from h""",
    "coverage_metrics": f"with {_COUNTS} " + _METRICS % "c",
    "coverage_aggregate": f"with {_COUNTS}, t as (select l_suppkey, '' as path, sum(lf) as lf, sum(lh) as lh, sum(bf) as bf, sum(bh) as bh from c group by l_suppkey) " + _METRICS % "t",
    "lcov_import": f"with {_COUNTS} select l_suppkey as report_id, path, lf as lines_found, lh as lines_hit, bf as branches_found, bh as branches_hit from c",
    "sarif_findings": r"""with t as (select distinct report_id, cast(text as json) as t from sarif_reports where json_valid(text) and json_type(text) = 'OBJECT' and json_extract_string(text, '$.version') = '2.1.0'),
r as (select report_id, unnest(from_json(json_extract(t, '$.runs'), '["JSON"]')) as run, unnest(range(json_array_length(t, '$.runs')::bigint)) as run_no from t where json_type(t, '$.runs') = 'ARRAY'),
s as (select report_id, run_no, json_extract(run, '$.tool.driver.rules') as rules, unnest(from_json(json_extract(run, '$.results'), '["JSON"]')) as x, unnest(range(json_array_length(run, '$.results')::bigint)) as result_no from r where json_type(run, '$.results') = 'ARRAY'),
k as (select *, nullif(trim(json_extract_string(x, '$.ruleId')), '') as named, try_cast(json_extract_string(x, '$.ruleIndex') as bigint) as ix, lower(trim(coalesce(json_extract_string(x, '$.level'), ''))) as level from s where json_type(x) = 'OBJECT')
select report_id, run_no, result_no, coalesce(named, case when ix >= 0 then json_extract_string(rules, '$[' || ix || '].id') end, 'sarif.finding') as key,
  case when level in ('error', 'critical', 'blocker') then 'error' when level in ('warning', 'warn', 'major') then 'warning' when level in ('note', 'info', 'minor') then 'note' when level in ('none', '') then 'none' else level end as severity,
  replace(regexp_replace(coalesce(json_extract_string(x, '$.locations[0].physicalLocation.artifactLocation.uri'), ''), '^file://', ''), '\', '/') as path,
  try_cast(json_extract_string(x, '$.locations[0].physicalLocation.region.startLine') as bigint) as start_line from k""",
    "sarif_export": f"""with {_O}, p as (select *, row_number() over (partition by repository_id order by key nulls first, coalesce(path, ''), start_line nulls first, id) - 1 as nth from o where kind = 'finding' and state = 'current' and repository_id is not null)
select repository_id, nth, coalesce(nullif(trim(key), ''), 'sarif.finding') as key, case when severity in ('critical', 'high', 'error') then 'error' when severity in ('medium', 'warning') then 'warning' when severity in ('low', 'note') then 'note' else 'none' end as level,
  'finding ' || id as message, coalesce(path, '') as path, cast(start_line as bigint) as start_line from p where nth < 500""",
    "dependency_inventory": f"with {_INV} select repository, l_partkey, usage, version, latest, status, case when status = 'current' then 'none' when status <> 'behind' then 'unknown' when a[1] <> b[1] then 'major' when a[2] <> b[2] then 'minor' when a[3] <> b[3] then 'patch' else 'unknown' end as distance from s",
    "dependency_status_counts": f"with {_INV} select ecosystem, count(*) as declarations, count(*) filter (status = 'current') as current, count(*) filter (status = 'behind') as behind, count(*) filter (status = 'ahead') as ahead, count(*) filter (status = 'prerelease') as prerelease, count(*) filter (status = 'unresolved') as unresolved, count(*) filter (status = 'unavailable') as unavailable from s group by ecosystem",
    "dependency_search": f"with {_DECL} select repository, l_partkey from d where contains(lower(concat_ws(chr(10), repository, ecosystem, package, version, usage)), 'brand#2') and lower(usage) = 'r'",
    "registry_longest_prefix": "with r(prefix, registry) as (values " + ", ".join(f"('{p}', '{g}')" for p, g in ROUTES) + ") select p_partkey, arg_max(registry, length(prefix)) as registry from part join r on starts_with(lower(p_name), prefix) group by p_partkey",
    "advisory_range_join": f"""with x as (select record_id, unnest(affected) as f from advisories), e0 as (select record_id, f.ecosystem as ecosystem, f.name as package, f.ranges as ranges, f.versions as versions from x where f.ecosystem is not null and f.name is not null),
e as (select row_number() over () as n, record_id, lower(ecosystem) as eco, {_PKG} as pkg, ranges, versions from e0),
d as (select distinct ecosystem, package, (record_id % 13) || '.' || (record_id % 31) || '.' || (record_id % 17) as version, lower(ecosystem) as eco, {_PKG} as pkg from e0),
j as (select e.n, record_id, ecosystem, package, version, d.eco, ranges, coalesce(list_contains(versions, version), false) as listed, {version_sql('d.eco', 'version')} as mine from d join e on d.eco = e.eco and d.pkg = e.pkg),
r as (select n, record_id, ecosystem, package, version, eco, mine, unnest(ranges) as r, unnest(range(len(ranges))) as i from j), w as (select * exclude (r), r.events as events from r where r.events is not null),
m as (select n, record_id, ecosystem, package, version, eco, mine, i, unnest(events) as m from w),
p as (select * exclude (m), m.fixed as fixed, coalesce(nullif(m.introduced, ''), nullif(m.fixed, ''), nullif(m.last_affected, ''), nullif(m."limit", '')) as v,
  case when coalesce(m.introduced, '') <> '' then 0 when coalesce(m.fixed, '') <> '' then 1 when coalesce(m.last_affected, '') <> '' then 2 else 3 end as kind from m),
q as (select * exclude (v), case when v = '0' then '' else {version_sql('eco', 'v')} end as k from p where v is not null),
o as (select n, ecosystem, package, version, mine, i, list((k, kind) order by k, kind) as marks from q group by all),
s as (select n, ecosystem, package, version, list_reduce(marks, lambda a, b: case when a = 2 then 2 when b[2] = 0 then case when mine >= b[1] then 1 else 0 end when a = 1 and ((b[2] = 2 and mine <= b[1]) or (b[2] <> 2 and mine < b[1])) then 2 else 0 end, 0) as state from o),
h as (select distinct n, ecosystem, package, version from s where state >= 1 union select n, ecosystem, package, version from j where listed),
f as (select n, ecosystem, package, version, arg_min(fixed, (k2, fixed)) as fixed from (select *, {version_sql('eco', 'fixed')} as k2 from q where coalesce(fixed, '') <> '') where k2 > mine group by all)
select distinct record_id, ecosystem, package, version, fixed from h join (select distinct n, record_id from e) using (n) left join f using (n, ecosystem, package, version)""",
    "advisory_gaps": """with x as (select record_id, unnest(affected) as f from advisories), e as (select distinct record_id, lower(f.ecosystem) as ecosystem, lower(f.name) as package from x where f.name is not null),
d as (select distinct ecosystem, package from e where record_id % 3 = 0) select e.* from e where not exists (select 1 from d where d.ecosystem = e.ecosystem and d.package = e.package)""",
    "advisory_severities": """with s as (select record_id, unnest(severity) as e from advisories), t as (select record_id, trim(e.score) as t, starts_with(e.score, 'CVSS:3.') as vector from s),
m as (select *, list_extract([0.85, 0.62, 0.55, 0.2], strpos('NALP', regexp_extract(t, '/AV:([A-Z])', 1)))::double as av, list_extract([0.77, 0.44], strpos('LH', regexp_extract(t, '/AC:([A-Z])', 1)))::double as ac, list_extract([0.85, 0.62], strpos('NR', regexp_extract(t, '/UI:([A-Z])', 1)))::double as ui,
  regexp_extract(t, '/S:([A-Z])', 1) = 'C' as changed, strpos('NLH', regexp_extract(t, '/PR:([A-Z])', 1)) as p, list_extract([0.56, 0.22, 0.0], strpos('HLN', regexp_extract(t, '/C:([A-Z])', 1)))::double as c, list_extract([0.56, 0.22, 0.0], strpos('HLN', regexp_extract(t, '/I:([A-Z])', 1)))::double as i, list_extract([0.56, 0.22, 0.0], strpos('HLN', regexp_extract(t, '/A:([A-Z])', 1)))::double as a from t where vector),
n as (select *, case when changed then [0.85, 0.68, 0.5][p] else [0.85, 0.62, 0.27][p] end::double as pr, 1 - (1 - c) * (1 - i) * (1 - a) as iss from m),
q as (select *, case when changed then 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) else 6.42 * iss end as impact from n),
x as (select record_id, case when impact <= 0 then 0.0 else ceil(least(case when changed then 1.08 else 1.0 end * (impact + 8.22 * av * ac * pr * ui), 10.0) * 10) / 10 end as score from q
  union all select record_id, case when regexp_matches(t, '^[0-9]+(?:\\.[0-9]+)?$') then cast(t as double) end from t where not coalesce(vector, false)),
w as (select record_id, coalesce(max(score), 0) as s from x group by record_id)
select a.record_id, case when s >= 9 then 'critical' when s >= 7 then 'high' when s >= 4 then 'medium' when s > 0 then 'low' else 'unknown' end as band from advisories a left join w using (record_id)""",
    "finding_dedup": f"""with {_O}, {_FIND}, g as (select advisory, repository, lower(package) as package, version, list_sort(list_distinct(list((usage_rank, path, line, relationship)))) as p from f group by all)
select advisory, repository, package, version, cast(len(p) as bigint) as occurrences, p[1][2] as primary_path, cast(p[1][3] as bigint) as primary_line from g""",
    "finding_headlines": f"with {_O}, {_FIND} select severity, tool, count(*) as findings, count(distinct repository) as repositories from f group by all",
    "finding_groups": f"with {_O}, {_FIND} select severity, tool, repository, package, count(*) as findings from f group by all",
    "snapshot_digest": "with f as (select distinct repository_id, md5(path || '@' || revision) as h from source_files) select repository_id, count(*) as n, " + ", ".join(f"bit_xor(cast('0x' || substr(h, {1 + 8 * k}, 8) as bigint)) as lane{k}" for k in range(4)) + " from f group by repository_id",
    "topology_runtime_metrics": f"""with {_RUN} select source, target, protocol, cast(coalesce(sum(request_count), 0) as bigint) as requests, cast(coalesce(sum(error_count), 0) as bigint) as errors, max(latency_p95_ms) as p95_ms, min(observed_from) as first_seen, max(observed_to) as last_seen,
  case when min(provider) is not distinct from max(provider) then min(provider) else 'multiple' end as provider, case when min(environment) = max(environment) then min(environment) else 'multiple' end as environment,
  case when coalesce(sum(request_count), 0) > 0 then round(coalesce(sum(error_count), 0) / sum(request_count), 9) end as error_rate from rt group by source, target, protocol""",
    "topology_full_outer_merge": f"""with {_RUN}, s as (select distinct source, target, protocol, case when length(target) % 2 = 0 then environment else '' end as environment from rt where provider = 'tracehub'),
r as (select distinct source, target, protocol, environment from rt where provider <> 'tracehub'),
j as (select r.*, a.source is not null as hit, b.source is not null as loose from r left join s a on a.source = r.source and a.target = r.target and a.protocol = r.protocol and a.environment = r.environment
  left join s b on b.source = r.source and b.target = r.target and b.protocol = r.protocol and b.environment = ''),
z as (select source, target, protocol, environment, case when hit or loose then 'confirmed' else 'runtime_only' end as state, case when hit then environment when loose then '' end as static_environment from j)
select * from z union all select source, target, protocol, environment, 'static_only', environment from s where not exists (select 1 from z where z.state = 'confirmed' and z.source = s.source and z.target = s.target and z.protocol = s.protocol and z.static_environment = s.environment)""",
    "topology_alias_unique": f"""with a as (select distinct id, {_SERVICE.format('x')} as alias from (select id, unnest([name, path]) as x from repositories)), k as (select alias, count(*) as n, min(id) as id from a where alias <> '' group by alias),
n as (select 'http://' || upper(repository) || '.svc:80/x' as name from source_files union select source_name from runtime_observations where source_name is not null),
m as (select name, {_SERVICE.format('name')} as alias from n) select name, m.alias, case when n = 1 then id end as component_id, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unknown' end as resolution from m left join k using (alias)""",
    "placeholder_top_rank": """with f as (select distinct lower(trim(source_name)) as variable, environment, provider, case environment when 'production' then 3 when 'staging' then 2 else 1 end as rank from runtime_observations where source_name is not null and environment is not null)
select variable, cast(rank as bigint) as rank, environment, provider from f qualify rank() over (partition by variable order by rank desc) = 1""",
    "neighborhood_cap": """with l as (select l_suppkey as node, l_partkey as neighbour, count(*) as weight from lineitem group by all), r as (select *, row_number() over (partition by node order by weight desc, neighbour) as n from l)
select node, neighbour, weight, 0 as summarised from r where n <= 12 union all select node, null, cast(sum(weight) as bigint), count(*) from r where n > 12 group by node""",
    "runtime_window_overlap": "select provider, environment, count(*) as n, cast(sum(request_count) as bigint) as requests from (select distinct * from runtime_observations) where observed_from <= timestamp '2025-06-07 23:59:59' and observed_to >= timestamp '2025-06-01 00:00:00' group by all",
    "component_longest_prefix": """with f as (select distinct repository_id, path, string_split(path, '/') as a from source_files),
r as (select distinct repository_id, root from (select repository_id, array_to_string(a[1:1], '/') as root from f union all select repository_id, array_to_string(a[1:2], '/') from f) where length(root) % 3 <> 0 union select distinct repository_id, '' from f),
c as (select f.repository_id, path, root, case when root = '' then 0 else len(string_split(root, '/')) end as depth from f join r on f.repository_id = r.repository_id and (root = '' or starts_with(path, root || '/') ) where len(a) > 2)
select distinct repository_id, path, root, cast(depth as bigint) as depth from c qualify rank() over (partition by repository_id, path order by depth desc) = 1""",
    "graph_union": f"with {_EDGES} select node, count(*) as degree from (select src as node from e union all select dst from e) group by node",
    "graph_neighbors": f"with {_EDGES} select src as node, dst as neighbour from e where src in ('nation:3', 'supplier:7') union all select dst, src from e where dst in ('nation:3', 'supplier:7')",
    "graph_impact_bfs": f"with recursive {_EDGES}, b as (select 'nation:3' as node, 0 as distance union all select e.src, b.distance + 1 from b join e on e.dst = b.node where b.distance < 3) select node, cast(min(distance) as bigint) as distance from b group by node",
    "graph_traversed_edges": f"with {_EDGES}, n as (select 'region:1' as node union all select src from e where dst = 'region:1') select src || '>' || dst as id from e join n on dst = node",
    "graph_shortest_path": "select * from (values (0::bigint, 'customer:1'), (1, 'nation:' || (select c_nationkey from customer where c_custkey = 1)), (2, 'region:' || (select n_regionkey from nation join customer on n_nationkey = c_nationkey where c_custkey = 1))) t(step, node) where (select n_regionkey from nation join customer on n_nationkey = c_nationkey where c_custkey = 1) = 4",
    "reachability_closure": f"""with recursive {_EDGES}, b as (select 'order:' || o_orderkey as node, 0 as distance from orders where o_totalprice > 300000 union select e.dst, b.distance + 1 from b join e on e.src = b.node)
select node, cast(min(distance) as bigint) as distance from b group by node""",
    "containing_interval_min_span": """with o as (select repository_id, path, start_line, end_line, id, key from insight_observations where start_line is not null and end_line >= start_line and path is not null),
s as (select distinct repository_id, path, greatest(1, start_line - id % 40) as lo, end_line + id % 25 as hi, key as name from o), p as (select distinct repository_id, path, cast(start_line as bigint) as line from o)
select repository_id, path, line, name from p join s using (repository_id, path) where lo <= line and line <= hi qualify row_number() over (partition by repository_id, path, line order by hi - lo, name) = 1""",
    "edge_confidence_merge": """with e as (select l_suppkey as src, l_partkey as dst, 'supplies' as kind, case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'low' end as confidence, case l_returnflag when 'A' then 2 when 'N' then 1 else 0 end as r from lineitem)
select src, dst, kind, confidence, count(*) as evidence from e group by src, dst, kind, confidence, r qualify row_number() over (partition by src, dst, kind order by r desc) = 1""",
    "repository_access_semi": f"with {_O} select repository_id, count(*) as n from o where repository_id in (select id from repositories where not bare and scan_state = 'ok') group by repository_id",
    "repository_access_anti": "select id, name from repositories where id not in (select repository_id from documents where repository_id is not null)",
    "catalogue_scan": "with n as (select repository_id, count(distinct file_id) as files from source_files group by 1) select id, name, coalesce(files, 0) as files, head_commit = indexed_commit as fresh from repositories left join n on id = repository_id",
    "catalogue_sync": """with f as (select path || case when id % 10 = 1 then '-moved' else '' end as path, head_commit as head from repositories where id % 4 <> 0),
m as (select coalesce(f.path, r.path) as path, coalesce(f.head, r.indexed_commit) as head, case when f.path is not null then 0 else coalesce(r.discovery_misses, 0) + 1 end as misses,
  case when f.path is not null and r.path is not null and f.head = r.indexed_commit then r.index_state when f.path is not null then 'pending' else r.index_state end as state from repositories r full join f on r.path = f.path)
select path, head, cast(misses as bigint) as discovery_misses, state from m where misses < 3""",
    "upsert_latest": """with o as (select o_custkey, o_orderkey, o_totalprice from orders), a as (select o_custkey, max(o_orderkey) as k, arg_max(o_totalprice, o_orderkey) as p from o where o_orderkey % 2 = 0 group by 1),
b as (select o_custkey, max(o_orderkey) as k, arg_max(o_totalprice, o_orderkey) as p from o where o_orderkey % 3 = 0 group by 1)
select coalesce(b.o_custkey, a.o_custkey) as o_custkey, coalesce(b.k, a.k) as o_orderkey, coalesce(b.p, a.p) as o_totalprice from a full join b using (o_custkey)""",
    "audit_keyset_page": "select event_id, event_type, user_id from events where contains(lower(concat_ws(chr(10), event_type, props)), '7') and event_id < 8000 order by event_id desc limit 101",
    "identity_page": "select c_custkey, c_name from customer order by lower(c_name), c_custkey limit 40 offset 120",
    "output_bound": "select o_custkey, o_orderkey, sum(length(o_orderpriority)) over (partition by o_custkey order by o_orderkey desc rows unbounded preceding) > 60 as truncated from orders",
    "conversation_counts": "select conversation_id, count(*) as messages, min(created_at) as first_at, max(created_at) as last_at from (select distinct conversation_id, id, created_at from conversation_messages where conversation_id is not null) group by 1",
    "commit_ancestors": """with h as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as distance from orders)
select cast(o_orderkey as varchar) as revision, distance from h""",
    "monitor_delta": "with " + _MONITOR,
    "streaming_monitor": "with " + _MONITOR,
}
