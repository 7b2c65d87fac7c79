"""Coverage and analysis reports as observations.

A report is one text (a row); parsing is local to it.  ``texts`` has report_id and text throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalars import severity

_SARIF = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,version:string,semanticVersion:string,rules:array<struct<id:string,name:string>>>>,"
    "results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string,markdown:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>,"
    "partialFingerprints:map<string,string>,fingerprints:map<string,string>,suppressions:array<struct<kind:string>>>>>>"
)
_SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string,fingerprint:string,is_ignored:boolean>>>"
_JACOCO = "package array<struct<_name:string,sourcefile:array<struct<_name:string,counter:array<struct<_type:string,_missed:long,_covered:long>>>>>>"
_COBERTURA = "packages struct<package:array<struct<classes:struct<class:array<struct<_filename:string,lines:struct<line:array<struct<_number:int,_hits:long,_branch:string,`_condition-coverage`:string>>>>>>>>>"


def lcov(texts: DataFrame) -> DataFrame:
    """``report_id, record, path`` and counts; a record runs from SF to end_of_record, the next SF or the end."""
    line = F.posexplode(F.split("text", "\r\n|\n"))
    rows = texts.select("report_id", line.alias("pos", "line")).withColumn("line", F.trim("line"))
    # A text is one row, so numbering its records within it is local to the report.
    w = W.partitionBy("report_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    starts = F.startswith("line", F.lit("SF:"))
    ended = F.col("line") == "end_of_record"
    rows = rows.withColumn("record", F.sum(starts.cast("int")).over(w)).withColumn("ends", F.sum((ended | starts).cast("int")).over(w))
    rows = rows.withColumn("first", F.max(F.when(starts, F.col("ends"))).over(w)).filter((F.col("ends") == F.col("first")) & (F.col("record") > 0))
    number = lambda tag: F.coalesce(F.max(F.when(F.startswith("line", F.lit(tag)), F.expr(f"try_cast(trim(substring(line, {len(tag) + 1})) as double)"))), F.lit(0.0))
    return rows.groupBy("report_id", "record").agg(F.max(F.when(starts, F.trim(F.substring("line", 4, 4000)))).alias("path"), number("LF:").alias("lines_found"), number("LH:").alias("lines_hit"), number("BRF:").alias("branches_found"), number("BRH:").alias("branches_hit"))


def jacoco(texts: DataFrame) -> DataFrame:
    p = texts.select("report_id", F.explode(F.from_xml("text", T.DataType.fromDDL(_JACOCO)).getField("package")).alias("p"))
    f = p.select("report_id", "p._name", F.explode("p.sourcefile").alias("f"))
    count = lambda kind, what: F.coalesce(F.aggregate(F.filter("f.counter", lambda c: c["_type"] == kind), F.lit(0).cast("long"), lambda a, c: a + what(c)), F.lit(0)).cast("double")
    path = F.concat_ws("/", F.nullif("_name", F.lit("")), "f._name")
    both, hit = (lambda c: c["_missed"] + c["_covered"]), (lambda c: c["_covered"])
    return f.select("report_id", path.alias("path"), count("LINE", both).alias("lines_found"), count("LINE", hit).alias("lines_hit"), count("BRANCH", both).alias("branches_found"), count("BRANCH", hit).alias("branches_hit"))


def cobertura(texts: DataFrame) -> DataFrame:
    parsed = texts.select("report_id", F.explode(F.from_xml("text", T.DataType.fromDDL(_COBERTURA)).getField("packages").getField("package")).alias("p"))
    c = parsed.select("report_id", F.explode("p.classes.class").alias("c")).select("report_id", F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l"))
    # A line that several classes report counts once, with its greatest hits.
    per = c.groupBy("report_id", "path", F.col("l._number").alias("line")).agg(F.max("l._hits").alias("hits"), F.max(F.col("l._condition-coverage")).alias("cond"))
    part = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(cond, '[(]([0-9]+)/([0-9]+)[)]', {i}) as double)"), F.lit(0.0))
    return per.groupBy("report_id", "path").agg(F.count("*").cast("double").alias("lines_found"), F.count_if(F.col("hits") > 0).cast("double").alias("lines_hit"), F.sum(part(2)).alias("branches_found"), F.sum(part(1)).alias("branches_hit"))


def coverage_metrics(counts: DataFrame, key: list[str]) -> DataFrame:
    """Six metrics of every scope; a rate without a denominator is skipped, not zero."""
    rate = lambda hit, found: F.when(F.col(found) > 0, F.round(100 * F.col(hit) / F.col(found), 6))
    pairs = [("coverage.lines.covered", F.col("lines_hit")), ("coverage.lines.total", F.col("lines_found")), ("coverage.line", rate("lines_hit", "lines_found")), ("coverage.branches.covered", F.col("branches_hit")), ("coverage.branches.total", F.col("branches_found")), ("coverage.branch", rate("branches_hit", "branches_found"))]
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in pairs]))
    return counts.select(*key, items.alias("m")).select(*key, "m.metric", "m.value", F.when(F.col("m.value").isNull(), "skipped").otherwise("measured").alias("state"))


def coverage_total(counts: DataFrame, key: list[str]) -> DataFrame:
    """Sums over the files of a report: rates of sums, never means of rates."""
    return counts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("lines_found", "lines_hit", "branches_found", "branches_hit")]).withColumn("path", F.lit(""))


def _first_value(m: Column) -> Column:
    """The value of the least key that has one."""
    filled = F.filter(F.map_entries(m), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    return F.array_min(filled)["value"]


def sarif(texts: DataFrame) -> DataFrame:
    """Findings of SARIF 2.1.0 logs; other versions, malformed and null texts give none."""
    log = texts.select("report_id", F.from_json("text", _SARIF).alias("log")).filter("log.version = '2.1.0'")
    runs = log.select("report_id", F.posexplode("log.runs").alias("run_no", "run"))
    r = runs.select("report_id", "run_no", F.col("run.tool.driver.rules").alias("rules"), F.col("run.tool.driver.name").alias("tool"), F.posexplode("run.results").alias("result_no", "r")).filter("r is not null")
    named = F.nullif(F.trim("r.ruleId"), F.lit(""))
    by_index = F.when(F.col("r.ruleIndex") >= 0, F.try_element_at("rules", F.col("r.ruleIndex") + 1)["id"])
    loc = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    return r.select(
        "report_id", "run_no", "result_no", "tool", F.coalesce(named, by_index, F.lit("sarif.finding")).alias("key"), severity(F.col("r.level")).alias("severity"),
        F.coalesce(F.nullif(F.trim("r.message.text"), F.lit("")), F.trim("r.message.markdown"), F.lit("")).alias("message"),
        F.regexp_replace(F.regexp_replace(F.coalesce(loc["artifactLocation"]["uri"], F.lit("")), "^file://", ""), r"\\", "/").alias("path"),
        loc["region"]["startLine"].alias("start_line"), loc["region"]["endLine"].alias("end_line"),
        F.coalesce(_first_value(F.col("r.partialFingerprints")), _first_value(F.col("r.fingerprints")), F.lit("")).alias("fingerprint"), (F.coalesce(F.size("r.suppressions"), F.lit(0)) > 0).alias("suppressed"),
    )


def semgrep(texts: DataFrame) -> DataFrame:
    r = texts.select("report_id", F.posexplode(F.from_json("text", _SEMGREP).getField("results")).alias("result_no", "r"))
    return r.select("report_id", "result_no", F.col("r.check_id").alias("key"), severity(F.col("r.extra.severity")).alias("severity"), F.col("r.extra.message").alias("message"), F.regexp_replace("r.path", r"\\", "/").alias("path"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.col("r.extra.fingerprint").alias("fingerprint"), F.coalesce("r.extra.is_ignored", F.lit(False)).alias("suppressed"))


def to_sarif(findings: DataFrame, order: list[str], most: int = 500) -> DataFrame:
    """One SARIF log for each repository: the page of its first ``most`` findings, rules sorted, each once.

    Only the page is exported, so a log has a bounded size; the rank is a limit in each group before
    anything is brought together.  Levels: critical and high are errors, medium is a warning, low a note, the rest none.
    """
    level = F.when(F.col("severity").isin("critical", "high", "error"), "error").when(F.col("severity").isin("medium", "warning"), "warning").when(F.col("severity").isin("low", "note"), "note").otherwise("none")
    result = F.struct(F.col("key").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    page = findings.withColumn("_n", F.row_number().over(W.partitionBy("repository_id").orderBy(*order))).filter(F.col("_n") <= most)
    per = page.groupBy("repository_id").agg(F.sort_array(F.collect_set("key")).alias("rules"), F.sort_array(F.collect_list(F.struct("_n", result.alias("r")))).alias("rows"))
    run = F.struct(F.struct(F.struct(F.lit("strataquery").alias("name"), F.transform("rules", lambda k: F.struct(k.alias("id"))).alias("rules")).alias("driver")).alias("tool"), F.transform("rows", lambda x: x["r"]).alias("results"))
    return per.select("repository_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("text"), F.size("rows").alias("results"))
