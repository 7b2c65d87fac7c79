"""Answers of services - quality servers, package registries, advisory feeds - and listings of disks, as tables.

Nothing here calls a network: ``texts`` hold what was fetched, one answer a row, and parsing is local to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import versions
from ..functions.scalars import severity

_SONAR = (
    "component struct<key:string,measures:array<struct<metric:string,value:string>>>, issues array<struct<key:string,rule:string,severity:string,component:string,line:int,message:string,status:string,type:string,hash:string>>,"
    " projectStatus struct<status:string,conditions:array<struct<metricKey:string,status:string,actualValue:string,errorThreshold:string>>>"
)
_OBSERVATION = "struct<kind:string,key:string,value:double,severity:string,message:string,path:string,start_line:int,fingerprint:string,state:string>"


def sonar(texts: DataFrame) -> DataFrame:
    """Observations in answers of a quality server: measures as metrics, open issues as findings, gate conditions as thresholds.

    ``texts``: report_id, text.  Values that are no number are left out; closed issues too.
    """
    d = texts.select("report_id", F.from_json("text", _SONAR).alias("d"))
    row = lambda kind, key, value, sev, msg, path, line, print_, state: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.cast("double").alias("value"), sev.cast("string").alias("severity"), msg.cast("string").alias("message"), path.cast("string").alias("path"), line.cast("int").alias("start_line"), print_.cast("string").alias("fingerprint"), state.cast("string").alias("state"))
    null = F.lit(None)
    measures = F.transform("d.component.measures", lambda m: row("metric", m["metric"], m["value"].try_cast("double"), null, null, null, null, null, F.lit("measured")))
    open_ = F.filter("d.issues", lambda i: ~F.coalesce(F.upper(i["status"]), F.lit("OPEN")).isin("CLOSED", "RESOLVED"))
    issues = F.transform(open_, lambda i: row("finding", i["rule"], null, severity(i["severity"]), i["message"], F.regexp_replace(i["component"], "^[^:]*:", ""), i["line"], F.coalesce(i["hash"], i["key"]), F.lit("current")))
    gate = F.transform("d.projectStatus.conditions", lambda c: row("gate", c["metricKey"], c["actualValue"].try_cast("double"), null, c["errorThreshold"], null, null, null, F.lower(c["status"])))
    none = F.array().cast(f"array<{_OBSERVATION}>")
    rows = d.select("report_id", F.explode(F.concat(F.coalesce(measures, none), F.coalesce(issues, none), F.coalesce(gate, none))).alias("o"))
    return rows.select("report_id", "o.*").filter("kind = 'finding' or value is not null")


def backoff_seconds(failures: Column, first: int = 60, most: int = 6 * 3600) -> Column:
    """How long to wait before asking again after so many failures: doubling, at most six hours."""
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1)).cast("long")


def registry_versions(answers: DataFrame) -> DataFrame:
    """``ecosystem, package, version`` in registry answers (``ecosystem``, ``package``, ``text``) of six ecosystems.

    npm and PyPI give maps keyed by version, crates and NuGet lists, Maven XML metadata, Go a plain list;
    yanked and deprecated versions are left out where the answer tells.
    """
    low = F.lower("ecosystem")
    npm = F.map_keys(F.map_filter(F.from_json("text", "versions map<string,struct<deprecated:string>>")["versions"], lambda _, v: v["deprecated"].isNull()))
    pypi = F.map_keys(F.map_filter(F.from_json("text", "releases map<string,array<struct<yanked:boolean>>>")["releases"], lambda _, v: F.exists(v, lambda x: ~F.coalesce(x["yanked"], F.lit(False)))))
    crates = F.transform(F.filter(F.from_json("text", "versions array<struct<num:string,yanked:boolean>>")["versions"], lambda v: ~F.coalesce(v["yanked"], F.lit(False))), lambda v: v["num"])
    nuget = F.from_json("text", "versions array<string>")["versions"]
    maven = F.from_xml(F.when(low == "maven", F.col("text")), T.DataType.fromDDL("versioning struct<versions:struct<version:array<string>>>"))["versioning"]["versions"]["version"]
    go = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    found = F.when(low == "npm", npm).when(low == "pypi", pypi).when(low.isin("cargo", "crates.io"), crates).when(low == "nuget", nuget).when(low == "maven", maven).when(low == "go", go)
    return answers.select("ecosystem", "package", F.explode(found).alias("version")).filter("version is not null").distinct()


def latest_stable(available: DataFrame) -> DataFrame:
    """The greatest stable version of every package: a partial maximum."""
    good = available.filter(versions.stable(F.col("version")))
    return good.groupBy("ecosystem", "package").agg(F.max(F.struct(versions.version_key(F.col("ecosystem"), F.col("version")).alias("k"), "version")).alias("m")).select("ecosystem", "package", F.col("m.version").alias("latest"))


ADVISORY = (
    "id string, aliases array<string>, related array<string>, summary string, published timestamp, modified timestamp, withdrawn timestamp, severity array<struct<type:string,score:string>>,"
    " affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,severity:array<struct<type:string,score:string>>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>,versions:array<string>>>,"
    " references array<struct<type:string,url:string>>"
)


def advisory_records(texts: DataFrame) -> DataFrame:
    """Advisories of a feed (``record_id``, ``text``) as the advisory table has them; texts without an id give none."""
    d = texts.select("record_id", F.from_json("text", ADVISORY).alias("d")).filter("trim(d.id) <> ''")
    affected = F.transform("d.affected", lambda a: F.struct(a["package"]["ecosystem"].alias("ecosystem"), a["package"]["name"].alias("name"), a["package"]["purl"].alias("purl"), a["severity"].alias("severity"), a["ranges"].alias("ranges"), a["versions"].alias("versions")))
    return d.select("record_id", "d.id", "d.aliases", "d.related", "d.summary", "d.published", "d.modified", "d.withdrawn", "d.severity", affected.alias("affected"), F.col("d.references").alias("refs"))


def feed_batches(packages: DataFrame, size: int = 1000) -> DataFrame:
    """Packages in request batches of at most ``size``: batch numbers come from a hash, so no package is counted off in one task."""
    n = packages.count()
    return packages.withColumn("batch", F.pmod(F.xxhash64(*packages.columns), F.lit(max(1, -(-n // max(size // 2, 1))))))


# ---------------------------------------------------------------- disks
def discover_repositories(listing: DataFrame) -> DataFrame:
    """Repositories in a listing of files (``path``): working copies by ``.git``, bare ones by HEAD beside objects and refs.

    What lies inside another repository's ``.git`` is none.  Marks are grouped by folder: one shuffle.
    """
    p = F.col("path")
    work = F.regexp_extract(p, r"^(.*?)/\.git/HEAD$", 1)
    bare = F.regexp_extract(p, r"^(.*)/(?:HEAD|objects/.+|refs/.+)$", 1)
    mark = F.when(p.rlike(r"/HEAD$"), "head").when(p.rlike(r"/objects/"), "objects").when(p.rlike(r"/refs/"), "refs")
    inside = p.rlike(r"/\.git/")
    rows = listing.select(F.when(inside & (work != ""), work).when(~inside, F.regexp_extract(p, r"^(.*?)/(?:HEAD$|objects/|refs/)", 1)).alias("root"), inside.alias("work"), mark.alias("mark")).filter("root <> '' and mark is not null")
    per = rows.groupBy("root").agg(F.max("work").alias("work"), F.count_distinct("mark").alias("marks"))
    return per.filter("work or marks = 3").select(F.col("root").alias("path"), F.regexp_replace(F.element_at(F.split("root", "/"), -1), r"\.git$", "").alias("name"), (~F.col("work")).alias("bare"))


def inspect_repositories(files: DataFrame) -> DataFrame:
    """``path, default_revision, head_commit, origin_url`` from the texts of HEAD, refs, packed-refs and config.

    ``files``: path (of the repository), file (below its git folder), text.  HEAD names a branch or a
    commit; a loose ref wins over a packed one.
    """
    pick = lambda name: F.max(F.when(F.col("file") == name, F.col("text")))
    loose = F.map_from_entries(F.collect_list(F.when(F.startswith("file", F.lit("refs/")), F.struct(F.col("file").alias("k"), F.trim(F.regexp_replace("text", r"\s+$", "")).alias("v")))))
    per = files.groupBy("path").agg(pick("HEAD").alias("head"), pick("packed-refs").alias("packed"), pick("config").alias("config"), loose.alias("loose"))
    ref = F.regexp_extract("head", r"^ref:\s*(\S+)", 1)
    packed = F.call_function("regexp_extract", F.coalesce("packed", F.lit("")), F.concat(F.lit(r"(?m)^([0-9a-f]{40,64}) \Q"), ref, F.lit(r"\E$")), F.lit(1))
    commit = F.when(ref == "", F.regexp_extract("head", r"^([0-9a-f]{40,64})", 1)).otherwise(F.coalesce(F.try_element_at("loose", ref), packed, F.lit("")))
    origin = F.regexp_extract(F.coalesce("config", F.lit("")), r"""(?s)\[remote "origin"\][^\[]*?url\s*=\s*(\S+)""", 1)
    return per.select("path", F.regexp_replace(ref, "^refs/heads/", "").alias("default_revision"), commit.alias("head_commit"), F.regexp_replace(origin, "://[^@/]*@", "://").alias("origin_url"))
