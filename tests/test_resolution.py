from pyspark.sql import functions as F

from conftest import rows
from strataquery.operators import resolution
from strataquery.streaming import monitors


def test_placeholder_tiers(spark):
    p = spark.createDataFrame([("a", "X_URL", "", "k1"), ("a", "Y_URL", "http://dflt:1/", None), ("a", "z_url", None, None), ("a", "AMB", None, None), ("a", "ORDERS_SERVICE_HOST", None, "k2"), ("a", "Q", None, None)], "source string, variable string, default_value string, map_key string")
    reg = spark.createDataFrame([("k1", "billing.svc"), ("k2", "one"), ("k2", "two")], "map_key string, value string")
    asg = spark.createDataFrame([("Z_URL", "http://ledger", 3), ("z_url", "http://old", 1), ("AMB", "a", 2), ("amb", "b", 2), ("Q", "", 9)], "variable string, value string, rank int")
    got = {r.variable: (r.tier, r.target) for r in resolution.resolve_placeholders(p, reg, asg).collect()}
    assert got == {"X_URL": ("registry", "billing"), "Y_URL": ("default", "dflt"), "z_url": ("assignment", "ledger"), "AMB": ("ambiguous_assignment", None), "ORDERS_SERVICE_HOST": ("ambiguous_registry", None), "Q": ("unresolved", None)}


def test_client_references(spark):
    refs = spark.createDataFrame([("A", "http://b", "low"), ("a", "B.x", "high"), ("a", "a", "high"), ("a", "zz", "high"), ("b", "a", "low"), ("b", "a", "low")], "source string, target string, confidence string")
    services = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(resolution.client_references(refs, services)) == [("a", "b", "high", 1), ("b", "a", "low", 2)]


def test_effective_roles(spark):
    t = lambda d, s: spark.createDataFrame(d, s)
    got = resolution.effective_roles(t([(1, "viewer"), (2, "editor"), (3, None)], "id int, role string"), t([(1, 7), (9, 7)], "id int, group_id int"), t([(7, "editor")], "group_id int, role string"), t([(2, "Ops"), (1, "x")], "id int, name string"), t([("oPS", "admin")], "name string, role string"))
    assert rows(got) == [(1, "editor"), (2, "admin"), (3, "none")]


def test_message_edges(spark):
    lines = spark.createDataFrame([("r", "a", 1, 'kafka.send("Orders.v1", x)'), ("r", "a", 2, '@KafkaListener(topics = "pay")'), ("r", "b", 1, 'mail.send("nobody")')], "repository string, path string, number int, line string")
    assert rows(resolution.message_edges(lines).select("source", "target")) == [("pay", "r"), ("r", "orders.v1")]


def test_component_reasons(spark):
    c = spark.createDataFrame([("", "a", True, False, 1), ("demo-x", "a", True, False, 1), ("x", "tests/x", True, False, 1), ("localhost", "", False, True, 3), ("s3", "", False, True, 0), ("infra", "i", False, False, 2), ("api", "src", True, False, 0)], "name string, path string, has_source boolean, external boolean, references int")
    assert [r.reason for r in resolution.root_reasons(c).collect()] == ["no name", "test or example", "test or example", "loopback", "orphaned external", "no deployable source", "kept"]


def test_streams_with_watermarks(spark, tmp_path):
    schema = "id long, source_name string, target_name string, observed_from timestamp, request_count long, error_count long, created_at timestamp"
    rows_ = [(1, "a", "b", 5, 1), (1, "a", "b", 5, 1), (2, "a", "b", 7, 2), (3, "a", "b", 90, 0)]
    df = spark.createDataFrame([(i, s, t, m, r) for i, s, t, m, r in rows_], "id long, source_name string, target_name string, m int, r int")
    at = F.to_timestamp(F.lit("2025-01-01 00:00:00")) + F.expr("make_interval(0, 0, 0, 0, 0, m, 0)")
    df.select("id", "source_name", "target_name", at.alias("observed_from"), F.col("r").cast("long").alias("request_count"), F.lit(0).cast("long").alias("error_count"), at.alias("created_at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = monitors.windowed_requests(stream)
    q = out.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select requests from windowed")) == [(0,), (4,)]
    q = monitors.first_deliveries(stream).writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from once").first()[0] == 3
