import datetime as dt
import json
import random

from pyspark.sql import functions as F

from conftest import rows
from strataquery.operators import intervals, nested, snapshots

T0 = dt.datetime(2025, 1, 1)
RUNS = "id long, monitor_id string, result_keys_json string, status string, created_at timestamp, snapshot_id string, idx int"


def run(i, m, keys, hours, status="complete"):
    return (i, m, json.dumps(keys) if isinstance(keys, list) else keys, status, T0 + dt.timedelta(hours=hours), "clash", 9)


def test_monitor_changes(spark, scratch):
    data = [run(1, "m", ["a", "b"], 1), run(2, "m", ["b", "c", "c"], 2), run(2, "m", ["b", "c", "c"], 2), run(3, "m", [], 3), run(4, "m", ["b"], 4), run(5, "m", "[\"x\"", 5), run(6, "m", "null", 6), run(7, "m", None, 7), run(8, "m", ["zz"], 8, "failed"), run(9, "n", ["q"], 1), run(10, "m", ["b", "é"], 9)]
    got = rows(snapshots.monitor_changes(spark.createDataFrame(data, RUNS), scratch).drop("table_name"))
    assert got == sorted([("2", "a", "removed"), ("2", "c", "added"), ("3", "b", "removed"), ("3", "c", "removed"), ("4", "b", "added"), ("10", "é", "added")], key=repr)


def test_monitor_ties_and_empty(spark, scratch):
    data = [run(2, "m", ["a"], 1), run(1, "m", ["b"], 1)]
    assert rows(snapshots.monitor_changes(spark.createDataFrame(data, RUNS), scratch).drop("table_name")) == [("2", "a", "added"), ("2", "b", "removed")]
    assert rows(snapshots.monitor_changes(spark.createDataFrame([], RUNS), scratch)) == []


OBS = "id long, run_id string, repository_id long, tool string, branch string, kind string, key string, severity string, message string, path string, start_line int, fingerprint string, suppressed boolean, state string, observed_at timestamp"


def obs(i, run_id, hours, fp, sev="low", msg="m", line=1, **kw):
    d = dict(id=i, run_id=run_id, repository_id=1, tool="t", branch="b", kind="finding", key="k", severity=sev, message=msg, path="p", start_line=line, fingerprint=fp, suppressed=False, state="current", observed_at=T0 + dt.timedelta(hours=hours))
    d.update(kw)
    return tuple(d.values())


def test_finding_changes(spark, scratch):
    data = [
        obs(1, "r1", 1, " f "), obs(2, "r1", 1, None), obs(3, "r2", 2, "f", "LOW"), obs(4, "r2", 2, "", line=2), obs(5, "r3", 3, "f", "high"), obs(6, "r3", 3, "f", "low"), obs(7, "r4", 4, "f", "mid"),
        obs(8, "r4", 4, "s", suppressed=True), obs(9, "r4", 4, "q", state="quarantined"), obs(10, "r4", 4, "n", suppressed=None), obs(11, "x1", 1, "f", tool=None), obs(12, "x2", 2, "g", tool=None),
    ]
    got = rows(snapshots.finding_changes(spark.createDataFrame(data, OBS), scratch).drop("table_name"))
    want = [("r2", "k|p|1|m", "removed"), ("r2", "k|p|2|m", "added"), ("r3", "k|p|2|m", "removed"), ("r4", "f", "changed"), ("x2", "f", "removed"), ("x2", "g", "added")]
    assert got == sorted(want, key=repr)


def brute_periods(data):
    by = {}
    for a, b, lo, hi in data:
        by.setdefault((a, b), []).append((lo, hi))
    out = []
    for (a, b), v in by.items():
        merged = []
        for lo, hi in sorted(v):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out += [(a, b, "period", lo, hi) for lo, hi in merged]
        out += [(a, b, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def test_periods_against_brute_force(spark):
    rng = random.Random(1)
    for cell in (7, 50, 10_000):
        data = [(rng.choice("aaaab"), rng.choice("xxy"), lo, lo + rng.choice([0, 0, 1, 3, 20, 90])) for lo in (rng.randint(-50, 400) for _ in range(160))]
        data += data[:20]
        df = spark.createDataFrame(data, "a string, b string, lo long, hi long").repartition(5)
        assert rows(intervals.periods_and_gaps(df, cell)) == brute_periods(set(data))
    assert rows(intervals.periods_and_gaps(spark.createDataFrame([], "a string, b string, lo long, hi long"))) == []


def test_periods_of_observations(spark, tmp_path):
    t = lambda h: T0 + dt.timedelta(hours=h)
    cols = "source_name string, target_name string, observed_from timestamp_ntz, observed_to timestamp_ntz, kind string, from_us long"
    data = [(" A ", "b", t(1), t(2), "k", 1), ("a", "B\t", t(2), t(3), None, None), ("a", "b", t(5), t(5), "", 0), (None, "b", t(1), t(2), "", 0), ("", "b", t(1), t(2), "", 0), ("a", "b", t(9), t(8), "", 0), ("a", "b", None, t(8), "", 0), ("a", " ", t(1), t(2), "", 0)]
    spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/runtime_observations.parquet")
    us = lambda h: 1735689600000000 + h * 3_600_000_000
    assert rows(intervals.p5_found(spark, str(tmp_path))) == sorted([("a", "b", "period", us(1), us(3)), ("a", "b", "gap", us(3), us(5)), ("a", "b", "period", us(5), us(5))], key=repr)


ADV = "record_id long, severity array<struct<type:string,score:string,source:string>>, affected array<struct<ecosystem:string,name:string,purl:string,severity:array<struct<type:string,score:string,source:string>>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string,last_affected:string,`limit`:string>>>>,versions:array<string>>>, refs array<struct<type:string,url:string>>, node string, path_no int"


def test_advisory_nodes(spark):
    ev = (None, "1", None, None)
    aff = ("npm", "x", None, [("t", "s", "z"), None], [None, ("R", None, [ev, None, (None, None, None, None)]), ("R", None, []), ("R", None, None)], None)
    data = [(1, [None, ("a", "b", "c")], [aff, None, (None,) * 6], None, "n", 3), (2, None, None, None, None, None), (3, [], [], [], "x", 1), (4, [(None, None, None)], None, [("t", "u")], "", 0)]
    df = spark.createDataFrame(data, ADV)
    got = rows(nested.nodes(df, "record_id", nested.ADVISORY_PATHS))
    a = "affected[0]"
    want = [(1, "severity[1]", ""), (1, a, ""), (1, "affected[2]", ""), (1, f"{a}.severity[0]", a), (1, f"{a}.ranges[1]", a), (1, f"{a}.ranges[2]", a), (1, f"{a}.ranges[3]", a), (1, f"{a}.ranges[1].events[0]", f"{a}.ranges[1]"), (1, f"{a}.ranges[1].events[2]", f"{a}.ranges[1]"), (4, "severity[0]", ""), (4, "refs[0]", "")]
    assert got == sorted(want, key=repr)
    assert rows(nested.nodes(df.limit(0), "record_id", nested.ADVISORY_PATHS)) == []
    flat = rows(nested.flat_table(df, "record_id", ["affected", "ranges", "events"]).select("node", "parent_node", "introduced", "fixed"))
    assert flat == [(f"{a}.ranges[1].events[0]", f"{a}.ranges[1]", None, "1"), (f"{a}.ranges[1].events[2]", f"{a}.ranges[1]", None, None)]


def test_json_nodes(spark):
    whole = {"runs": [None, {"results": [{"locations": {"x": 1}}, 5, {}]}, "s", {"results": {"locations": [{}, None, {"a": 1}]}}]}
    texts = [json.dumps(whole), json.dumps(json.dumps(whole)), None, "", "x", "[]", "5", '{"runs": []}', '{"runs": "a"}', '{"runs": null}', '{"a": NaN}', '"\\"x\\""', json.dumps(whole)[:-1]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "d")], "report_id long, text string, node string")
    got = rows(nested.json_nodes(df, "report_id", "text", nested.SARIF_PATHS))
    want = [("runs[1]", ""), ("runs[3]", ""), ("runs[1].results[0]", "runs[1]"), ("runs[1].results[2]", "runs[1]"), ("runs[3].results[0]", "runs[3]"), ("runs[1].results[0].locations[0]", "runs[1].results[0]"), ("runs[3].results[0].locations[0]", "runs[3].results[0]"), ("runs[3].results[0].locations[2]", "runs[3].results[0]")]
    assert got == sorted([(i, *w) for i in (0, 1) for w in want], key=repr)


def test_ordered_index_is_total(spark, scratch):
    from strataquery.operators.ordering import ordered_index

    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id"))
    got = ordered_index(df, ["g", "id"], scratch, "x").orderBy("idx").collect()
    assert [(r.g, r.id) for r in got] == sorted((i % 7, i) for i in range(1000)) and [r.idx for r in got] == list(range(1, 1001))
    assert ordered_index(df.limit(0), ["g", "id"], scratch, "y").count() == 0


def test_reports_with_long_integers():
    text = '{"runs": [{"n": ' + "1" * 5000 + "}]}"
    assert list(nested.parse_object(text)) == list(nested.parse_object(json.dumps(text))) == ["runs"]
    assert nested.parse_object("1" * 5000) is None


def test_intervals_in_small_pieces(spark, monkeypatch):
    """Whole cells are merged a few rows at a time; the answer is that of all at once."""
    import pyarrow as pa

    rng = random.Random(12)
    data = sorted((f"k{rng.randrange(5)}", "t", rng.randrange(4), 0, lo, lo + rng.randrange(30)) for lo in (rng.randrange(500) for _ in range(200)))
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*data)], names=["a", "b", "cell", "tag", "lo", "hi"])
    every = sorted(r for b in intervals._node([batch]) for r in zip(*b.to_pydict().values()))
    monkeypatch.setattr(intervals, "_FLUSH_ROWS", 7)
    assert sorted(r for b in intervals._node([batch.slice(i, 3) for i in range(0, 200, 3)]) for r in zip(*b.to_pydict().values())) == every
