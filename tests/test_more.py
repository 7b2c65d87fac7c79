import pytest
from pyspark.sql import functions as F

from conftest import rows
from strataquery.functions import scalars
from strataquery.operators import contexts, search, symbols
from strataquery.operators.contexts import Scope
from strataquery.operators.skew import replicated, salted
from strataquery.sources.python_syntax import facts, python_facts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scopes():
    a, b, c, d = Scope(1), Scope(1, "src"), Scope(1, "src/a.go", False), Scope(2, "src/a.go", False, (3, 9))
    assert contexts.compact([b, a, c, d, d]) == [a, d]
    assert contexts.compact([b, c, Scope(1, "srcx")]) == [b, Scope(1, "srcx")]
    assert contexts.covers(Scope(2, "f", False), Scope(2, "f", False, (1, 2))) and not contexts.covers(Scope(2, "f", False, (1, 2)), Scope(2, "f", False))


def test_scope_rows(spark):
    df = spark.createDataFrame([(1, "src/a", 1), (1, "srcx", 1), (2, "f", 5), (2, "f", 50)], "r int, p string, n int")
    pick = lambda s: rows(df.filter(contexts.scope_predicate(s, F.col("r"), F.col("p"), F.col("n"))))
    assert pick([Scope(1, "src")]) == [(1, "src/a", 1)]
    assert pick([Scope(2, "f", False, (1, 9))]) == [(2, "f", 5)]
    assert pick([]) == []


def test_allowed_ids():
    assert contexts.allowed_ids([], {1}) is None
    assert contexts.allowed_ids([{1, 2}, {2, 3}], set()) == {2}
    assert contexts.allowed_ids([{1}, set()], set()) == set()
    assert contexts.allowed_ids([{1, 2}], {2}) == {1}


def test_effective_contexts(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(contexts.effective(("b", a), ("a", a.filter("k = 1")))) == [(1, "a,b"), (2, "b")]


def test_fragments(spark):
    got = one(spark, search.fragments(F.lit("xAAaa é aaz"), "aa"))
    assert [(f.start, f.end) for f in got] == [(1, 3), (3, 5), (8, 10)]
    assert one(spark, search.fragments(F.lit("none"), "aa")) == []


@pytest.mark.parametrize("name,words", [("parseHTTPServer2", ["parse", "http", "server", "2"]), ("snake_case-x", ["snake", "case", "x"]), ("", [])])
def test_identifier_parts(spark, name, words):
    assert one(spark, scalars.identifier_parts(F.lit(name))) == words


def test_text_functions(spark):
    assert one(spark, scalars.without_comments(F.lit('a // x\n"//y" /* z\n */ b'))) == 'a \n"//y"  b'
    assert one(spark, scalars.bounded(F.lit("  a \n b  c"), 3)) == "a b…"
    assert one(spark, scalars.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(spark, scalars.private_package(F.lit("@Acme/x-y"), ["acme"])) and not one(spark, scalars.private_package(F.lit("acmes"), ["acme"]))
    now = F.lit("2025-01-02").cast("timestamp")
    assert [one(spark, scalars.ttl_state(F.lit(s), F.lit(t).cast("timestamp"), now)) for s, t in (("ok", "2025-01-03"), ("error", "2025-01-03"), ("ok", "2025-01-02"))] == ["fresh", "failed", "stale"]
    assert one(spark, scalars.keyset_cursor(F.lit("a"), F.lit(1))) != one(spark, scalars.keyset_cursor(F.lit("a"), F.lit(2)))


def test_python_facts(spark):
    text = "import os\nfrom . import a\nclass A(B.C):\n    async def f(self):\n        os.path.join(1)\n"
    assert set(facts(text)) == {("relation", "import", "os", 1, 1), ("relation", "import", ".", 2, 2), ("symbol", "class", "A", 3, 5), ("relation", "extends", "B.C", 3, 3), ("symbol", "function", "f", 4, 5), ("relation", "call", "os.path.join", 5, 5)}
    assert facts("def (") == []
    df = spark.createDataFrame([("r", "a.py", text), ("r", "b.go", text), ("r", "c.py", None)], "repository string, path string, text string")
    assert python_facts(df).count() == 6


def test_names_and_targets(spark):
    got = [one(spark, symbols.target_name(F.lit(t))) for t in ("*pkg.Type<T>", "a::b::c", "List[str]", "new Foo(1)", "x->y;")]
    assert got == ["Type", "c", "List", "new Foo", "y"]
    df = spark.createDataFrame([("a.b.Run",), ("Runner",), ("run",)], "n string")
    pick = lambda *a: [r.n for r in df.filter(symbols.name_match(F.col("n"), *a)).collect()]
    assert pick("run") == ["a.b.Run", "run"] and pick("run", "prefix") == ["a.b.Run", "Runner", "run"] and pick("Run", "contains", True) == ["a.b.Run", "Runner"]
    with pytest.raises(ValueError):
        pick("x", "fuzzy")


def test_resolution_and_precedence(spark):
    rel = spark.createDataFrame([(1, "p", 1, "x.A"), (1, "p", 2, "B<T>"), (1, "p", 3, "Z")], "repository_id int, path string, line int, target string")
    defs = spark.createDataFrame([(1, "A", "a.go"), (1, "B", "b1"), (1, "B", "b2")], "repository_id int, name string, def_path string")
    assert rows(symbols.resolve_targets(rel, defs).select("line", "state", "candidates", "def_path")) == [(1, "resolved", 1, "a.go"), (2, "ambiguous", 2, None), (3, "external", 0, None)]
    syntax = spark.createDataFrame([("p", "f", 1), ("q", "g", 1)], "path string, name string, n int")
    compiler = spark.createDataFrame([("p", "h", 2)], "path string, name string, n int")
    assert rows(symbols.merge_definitions(syntax, compiler, ["path"]).select("path", "name", "source")) == [("p", "h", "compiler"), ("q", "g", "syntax")]


def test_cap_tells_truncation(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 1)], "g string, n int")
    assert rows(symbols.capped(df, ["g"], [F.asc("n")], 3)) == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("b", 1, False)]
    assert {r.truncated for r in symbols.capped(df, ["g"], [F.asc("n")], 4).collect()} == {False}


def test_scip_resolution(spark):
    sym = spark.createDataFrame([("impl", [("iface", True)]), ("other", [("iface", False)]), ("x", None)], "id string, relationships array<struct<symbol:string,implementation:boolean>>")
    occ = spark.createDataFrame([("impl", 0), ("other", 4), ("iface", 9)], "symbol string, start_line int")
    wanted = spark.createDataFrame([("iface",)], "symbol string")
    assert rows(symbols.scip_resolve(sym, occ, wanted).select("symbol", "line")) == [("iface", 10), ("impl", 1)]


def test_salted_join_keeps_every_row(spark, monkeypatch):
    from strataquery.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("k3", "3"), ("zz", "z")], "k string, w string")
    salted_rows, heavy = salted(left, "k", "v", left.count())
    assert heavy is not None and salted_rows.filter("k = 'hot'").select("_salt").distinct().count() > 10
    got = salted_rows.join(replicated(right, "k", heavy), ["k", "_salt"]).select("k", "v", "w")
    assert rows(got) == rows(left.join(right, "k").select("k", "v", "w"))


def test_queries_and_sql_agree_on_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_salted_path(spark, monkeypatch):
    """A key that holds most rows is spread and still joins with each of its partners once."""
    from strataquery.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    side = spark.createDataFrame([(7, "a"), (9, "b"), (9, "c")], "k long, s string")
    left, heavy = salted(many, "k", "v", 3000)
    assert [r.k for r in heavy.collect()] == [7] and left.filter("k = 7").select("_salt").distinct().count() > 1
    assert left.join(replicated(side, "k", heavy), ["k", "_salt"]).count() == many.join(side, "k").count() == 2002


def test_hubs_are_salted(spark, scratch, monkeypatch):
    from strataquery.operators import graph, skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    edges = spark.range(1000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst")).unionByName(spark.createDataFrame([("n5", "deep"), ("deep", "hub")], "src string, dst string")).withColumn("id", F.concat("src", F.lit(">"), "dst"))
    hit = graph.reachable(edges, spark.createDataFrame([("hub",)], "node string"), scratch, witness=True)
    assert hit.count() == 1002
    assert [(r.distance, r.parent) for r in hit.filter("node = 'deep'").collect()] == [(2, "n5")]


def test_greedy_budget(spark, scratch):
    """Against the fold it stands for."""
    import random

    from strataquery.operators import store

    rng = random.Random(5)
    data = [(g, i, rng.choice([1, 3, 9, 40, 200])) for g in (1, 2, 3) for i in range(60)]
    want = []
    for g in (1, 2, 3):
        used = n = 0
        for _, i, s in [d for d in data if d[0] == g]:
            if used + s <= 100 and n < 12:
                want.append((g, i, used))
                used, n = used + s, n + 1
    df = spark.createDataFrame(data, "g int, i int, s int")
    got = rows(store.greedy_budget(df, "g", ["i"], "s", 100, 12, scratch).select("g", "i", "used"))
    assert got == sorted(want, key=repr)
    assert store.greedy_budget(df.limit(0), "g", ["i"], "s", 100, 12, scratch).count() == 0


def test_score_places(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.0,), (2000.5,), (3e6,), (2000.0,)], "score double")
    assert rows(search.score_places(df)) == sorted([(3e6, 1), (2000.5, 2), (2000.0, 3), (5.0, 4)], key=repr)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from strataquery import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_no_text_in_a_shuffle(spark):
    """Search and insight plans move what they derive, never the texts."""
    import re

    from strataquery.plans import catalogue

    for name in ("search_content_substring", "search_ranked_topk", "search_line_matches_context", "symbols_extract", "derived_metrics_rollup", "insight_facets", "insight_current_history", "finding_headlines"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for exchange in re.finditer(r"Exchange [^\n]*\n([^\n]*)", plan):
            assert not re.search(r"(?:content|message|text)#\d+", exchange.group(0)), (name, exchange.group(0))


def test_lines_of_a_folder_cover_nothing_else():
    some, part = Scope(1, "", True, (1, 9)), Scope(1, "lib")
    assert not contexts.covers(some, part) and contexts.compact([some, part, some]) == [some, part] and contexts.covers(Scope(1), some)
