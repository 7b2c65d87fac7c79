"""Topologies declared in configuration: tool servers, catalog entities, composed services, peers, assignments.

YAML is read by a reader of its own for the plain subset that configuration uses - block and flow maps
and lists, quoted and plain scalars, comments, literal and folded blocks - and is handed on as JSON,
so that everything behind it is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import service_name


class YamlError(ValueError):
    """A text beyond the subset, or no YAML."""


_QUOTED_OR_HASH = re.compile(r"""(?<![^\s\[{,:])(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|#""")


def _uncommented(line: str) -> str:
    """The line up to a comment: a sign behind a blank, outside quotes that open a word."""
    at = 0
    while at < len(line):
        m = _QUOTED_OR_HASH.search(line, at)
        if m is None:
            break
        if m.group() == "#" and (m.start() == 0 or line[m.start() - 1] in " \t"):
            return line[: m.start()]
        at = m.end()
    return line


def _scalar(s: str):
    s = s.strip()
    if s[:1] == '"' and s[-1:] == '"' and len(s) > 1:
        try:
            return json.loads(s)
        except ValueError:
            return s[1:-1]
    if s[:1] == "'" and s[-1:] == "'" and len(s) > 1:
        return s[1:-1].replace("''", "'")
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "false", "False"):
        return s.lower() == "true"
    return int(s) if re.fullmatch(r"[-+]?(?:0|[1-9]\d{0,17})", s) else s


_FLOW = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}"']|$)|(?:[^\[\]{},:\s]|:(?=\S)|\s+(?=[^\[\]{},:\s#]))+)""")


def _flow(text: str):
    tokens = [m.group(1).strip() for m in _FLOW.finditer(text)]
    stack: list = []
    at = 0

    def value():
        nonlocal at
        if at >= len(tokens):
            raise YamlError("a flow value ends too early")
        t = tokens[at]
        at += 1
        if t == "[":
            out = []
            while at < len(tokens) and tokens[at] != "]":
                out.append(value())
                if at < len(tokens) and tokens[at] == ",":
                    at += 1
            at += 1
            return out
        if t == "{":
            pairs = {}
            while at < len(tokens) and tokens[at] != "}":
                key = str(_scalar(tokens[at]))
                at += 1
                if at < len(tokens) and tokens[at] == ":":
                    at += 1
                    pairs[key] = None if at < len(tokens) and tokens[at] in ",}" else value()
                else:
                    pairs[key] = None
                if at < len(tokens) and tokens[at] == ",":
                    at += 1
            at += 1
            return pairs
        return _scalar(t)

    out = value()
    if at < len(tokens) or stack:
        raise YamlError("a flow value goes on behind its end")
    return out


_KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'"%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*)|$)""")


def parse_yaml(text: str):
    """The first document of a text as maps, lists and scalars; ``YamlError`` beyond the subset."""
    rows = []
    for raw in text.lstrip("﻿").replace("\r\n", "\n").split("\n"):
        if raw.strip() == "---" or raw.startswith("%"):
            if rows and any(r[1] for r in rows):
                break
            continue
        if raw.strip() == "...":
            break
        rows.append((len(raw) - len(raw.lstrip(" ")), _uncommented(raw).rstrip(), raw))
    at = 0

    def skip():
        nonlocal at
        while at < len(rows) and not rows[at][1].strip():
            at += 1

    def block_text(indent: int, style: str) -> str:
        nonlocal at
        lines: list[str] = []
        inner = None
        while at < len(rows):
            raw = rows[at][2]
            if raw.strip():
                if rows[at][0] <= indent:
                    break
                inner = rows[at][0] if inner is None else inner
            lines.append(raw[inner or 0 :] if raw.strip() else "")
            at += 1
        while lines and not lines[-1]:
            lines.pop()
        body = "\n".join(lines) if style[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))
        return body + ("" if style.endswith("-") or not body else "\n")

    def inline(rest: str, indent: int):
        nonlocal at
        rest = re.sub(r"^[&!]\S+\s*", "", rest)
        if re.fullmatch(r"[|>][+-]?\d?", rest):
            return block_text(indent, rest)
        if rest[:1] in ("[", "{"):
            while rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and at < len(rows):
                rest += " " + rows[at][1].strip()
                at += 1
            return _flow(rest)
        if rest[:1] in ("*", "@", "`"):
            raise YamlError("references aren't read")
        return _scalar(rest)

    def node(indent: int):
        nonlocal at
        skip()
        if at >= len(rows) or rows[at][0] < indent:
            return None
        own = rows[at][0]
        line = rows[at][1].strip()
        if line == "-" or line.startswith("- "):
            out: list = []
            while True:
                skip()
                if at >= len(rows) or rows[at][0] != own or not (rows[at][1].strip() == "-" or rows[at][1].strip().startswith("- ")):
                    return out
                rest = rows[at][1].strip()[1:].strip()
                if not rest:
                    at += 1
                    out.append(node(own + 1))
                elif _KEY.match(rest) or rest.startswith("- "):
                    shift = own + (len(rows[at][1].strip()) - len(rest))
                    rows[at] = (shift, " " * shift + rest, " " * shift + rest)
                    out.append(node(shift))
                else:
                    at += 1
                    out.append(inline(rest, own))
        if _KEY.match(line):
            pairs: dict = {}
            while True:
                skip()
                if at >= len(rows) or rows[at][0] != own:
                    break
                m = _KEY.match(rows[at][1].strip())
                if m is None:
                    raise YamlError("a line is no pair")
                at += 1
                key, rest = str(_scalar(m.group(1))), (m.group(2) or "").strip()
                if rest and not re.fullmatch(r"[&!]\S+", rest):
                    pairs[key] = inline(rest, own)
                    continue
                skip()
                dash = at < len(rows) and rows[at][0] == own and (rows[at][1].strip() == "-" or rows[at][1].strip().startswith("- "))
                pairs[key] = node(own if dash else own + 1)
            if at < len(rows) and rows[at][0] > own:
                raise YamlError("a line is indented too far")
            return pairs
        at += 1
        return inline(line, own)

    out = node(0)
    skip()
    if at < len(rows):
        raise YamlError("text is left behind the document")
    return out


def yaml_json(files: DataFrame) -> DataFrame:
    """``repository, path, json`` of files (repository, path, text); what isn't read has no row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cols: list[list] = [[], [], []]
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    body = json.dumps(parse_yaml(text))
                except (YamlError, RecursionError):
                    continue
                for c, v in zip(cols, (repo, path, body)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["repository", "path", "json"])

    return files.filter("text is not null").select(F.col("repository").cast("string"), "path", "text").mapInArrow(run, "repository string, path string, json string")


_CONNECTION = ["repository", "path", "source", "target", "protocol", "interaction", "transport", "origin"]


def mcp_servers(files: DataFrame) -> DataFrame:
    """Tool servers named at any depth of a JSON configuration, as connections of the repository.

    Keys are read without ``_`` and ``-``, case apart.  Depth is unknown, so an Arrow map walks the values.
    """

    def found(value) -> Iterator[tuple[str, dict]]:
        stack = [value]
        while stack:
            now = stack.pop()
            if isinstance(now, list):
                stack += now
            elif isinstance(now, dict):
                for k, v in now.items():
                    if k.replace("_", "").replace("-", "").lower() != "mcpservers":
                        stack.append(v)
                    elif isinstance(v, dict):
                        yield from v.items()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for repo, path, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    doc = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                for name, conf in sorted(dict(found(doc)).items()):
                    url = conf.get("url") if isinstance(conf, dict) else None
                    for c, v in zip(cols, (repo, path, name, url if isinstance(url, str) and url else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["repository", "path", "name", "url"])

    rows = files.filter(F.contains(F.lower("text"), F.lit("mcp"))).select(F.col("repository").cast("string"), "path", "text").mapInArrow(run, "repository string, path string, name string, url string")
    return rows.select("repository", "path", F.col("repository").alias("source"), F.col("name").alias("target"), F.lit("mcp").alias("protocol"), F.lit("invokes").alias("interaction"), F.when(F.col("url").isNull(), "stdio").otherwise("streamable_http").alias("transport"), F.lit("static").alias("origin"))


def backstage(files: DataFrame) -> DataFrame:
    """What catalog components depend on and whose interfaces they consume."""
    schema = "kind string, metadata struct<name:string>, spec struct<dependsOn:array<string>,consumesApis:array<string>>"
    named = files.filter(F.lower(F.element_at(F.split("path", "/"), -1)).isin("catalog-info.yaml", "catalog-info.yml"))
    d = yaml_json(named).select("repository", "path", F.from_json("json", schema).alias("d")).filter("lower(d.kind) = 'component'")
    none = F.array().cast("array<string>")
    refs = d.select("repository", "path", F.coalesce("d.metadata.name", "repository").alias("source"), F.explode(F.concat(F.coalesce("d.spec.dependsOn", none), F.coalesce("d.spec.consumesApis", none))).alias("ref"))
    name = service_name(F.regexp_replace(F.regexp_replace(F.trim("ref"), "^[^:]*:", ""), "^[^/]*/", ""))
    return refs.select("repository", "path", "source", name.alias("target"), F.lit("unknown").alias("protocol"), F.lit("depends_on").alias("interaction"), F.lit("").alias("transport"), F.lit("declared").alias("origin")).filter("target <> ''").distinct()


def compose(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services of compose files (``alias_of`` the repository where a file has only one), and what they depend on.

    ``depends_on`` is a list or a map; a name that is no service of its file is external.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    docs = yaml_json(files.filter(F.contains(base, F.lit("compose")) & base.rlike(r"\.ya?ml$")))
    service = docs.select("repository", "path", F.explode(F.from_json("json", "services map<string,string>")["services"]).alias("name", "body"))
    per = service.groupBy("repository", "path").agg(F.count("*").alias("n"))
    services = service.select("repository", "path", "name").join(per, ["repository", "path"]).select("repository", "path", "name", F.when(F.col("n") == 1, F.col("repository")).alias("alias_of"))
    as_list = F.from_json("body", "depends_on array<string>")["depends_on"]
    as_map = F.map_keys(F.from_json("body", "depends_on map<string,string>")["depends_on"])
    edges = service.select("repository", "path", F.col("name").alias("source"), F.explode(F.array_distinct(F.coalesce(as_list, as_map))).alias("target"))
    known = service.select("repository", "path", F.col("name").alias("target"), F.lit(True).alias("resolved"))
    return services, edges.join(known, ["repository", "path", "target"], "left").select("repository", "path", "source", "target", F.lit("unknown").alias("protocol"), F.lit("depends_on").alias("interaction"), F.lit("").alias("transport"), F.lit("declared").alias("origin"), F.coalesce("resolved", F.lit(False)).alias("resolved"))


#: Public suffixes of more than one label that are taken as one; a parameter where a fuller list is at hand.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.sg", "com.hk", "github.io", "gitlab.io"]


def peer_name(host: Column, suffixes: list[str] | None = None) -> Column:
    """What an external host is called: addresses and bare hosts by their service name, others by their registrable domain."""
    low = F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
    parts = F.split(low, r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    long = tail(2).isin(suffixes if suffixes is not None else SUFFIXES)
    return F.when(low == "", "").when(low.rlike(r"^[0-9.]+$"), low).when(low.rlike(":") | ~F.contains(low, F.lit(".")), service_name(low)).when(long, tail(3)).otherwise(tail(2))


def peer_class(host: Column) -> Column:
    """loopback, address, internal (a bare or cluster name) or external."""
    low = F.lower(F.trim(host))
    return F.when(low.isin("localhost", "127.0.0.1", "0.0.0.0", "::1"), "loopback").when(low.rlike(r"^[0-9.]+$|:"), "address").when(~F.contains(low, F.lit(".")) | low.rlike(r"\.(?:local|internal|svc|cluster\.local|svc\.cluster\.local)$"), "internal").otherwise("external")


def external_to_components(peers: DataFrame, components: DataFrame) -> DataFrame:
    """``component_id`` of peers (``repository_id``, ``host``) whose name is the alias of just one other component.

    ``components``: id, repository_id, aliases.
    """
    alias = components.select("id", "repository_id", F.explode("aliases").alias("a")).select(F.col("id").alias("component_id"), F.col("repository_id").alias("_own"), service_name(F.col("a")).alias("_alias")).filter("_alias <> ''").distinct()
    per = alias.groupBy("_alias").agg(F.count_distinct("component_id").alias("_n"), F.min("component_id").alias("component_id"), F.min("_own").alias("_own"))
    own = peers.withColumn("_alias", service_name(F.col("host")))
    hit = (F.col("_n") == 1) & (F.col("_own") != F.col("repository_id"))
    return own.join(per, "_alias", "left").withColumn("component_id", F.when(hit, F.col("component_id"))).drop("_alias", "_n", "_own")


#: Folders and names that say infrastructure, endings a value may stand in, and markers of values that are elsewhere.
INFRASTRUCTURE = ["deploy", "deployment", "deployments", "k8s", "kubernetes", "helm", "charts", "terraform", "infra", "infrastructure", "iac", "overlays", "environments", "cdk"]
INDIRECT = ["${", "{{", "vault:", "vault/", "secret://", "secretkeyref", "secretsmanager", "keyvault", "valuefrom:", "ssm:", "ref("]
CONNECTION_WORDS = ["URL", "URI", "HOST", "ENDPOINT", "ADDRESS", "UPSTREAM", "ROUTE", "SERVICE", "BROKER", "BOOTSTRAP", "DATASOURCE", "TARGET"]
ENVIRONMENTS = ["production", "prod", "staging", "stage", "stg", "development", "dev", "qa", "uat", "sandbox", "preview"]


def assignment_rank(path: Column) -> Column:
    """How much an assignment in this file counts: infrastructure 3, application 2, other 1, no place for one 0."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    base = F.element_at(F.split(low, "/"), -1)
    folders = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    under = lambda names: F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    infra = under(INFRASTRUCTURE) | base.rlike(r"^(?:docker-)?compose\.|^values|\.tf$|\.tfvars$|deployment|manifest|^cdk\.json$")
    data = base.rlike(r"\.(?:ya?ml|json|toml|properties|env)$")
    code = base.rlike(r"\.(?:tf|tfvars|ts|m?js|cjs|py)$")
    service = base.rlike(r"^(?:application|bootstrap)(?:[-.].*)?\.(?:ya?ml|properties)$|^appsettings\..+\.json$")
    other = base.rlike(r"^\.env(?:\..*)?$|\.env$|^(?:config|settings)\.(?:ya?ml|json|toml)$|^appsettings\.json$")
    return F.when(infra & (data | code), 3).when(service, 2).when(under(["config", "configuration"]) & data, 2).when(other, 1).otherwise(0)


def assignment_environment(path: Column) -> Column:
    """The environment a path names: a region, or the first known word of a folder or file name; '' without."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    region = F.regexp_extract(low, r"(?:^|[/._-])([a-z]{2}(?:-gov)?-(?:north|south|east|west|central)(?:east|west)?-?[0-9])(?=$|[/._-])", 1)
    words = F.filter(F.split(low, r"[/._-]+"), lambda w: w.isin(ENVIRONMENTS))
    return F.when(region != "", region).otherwise(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))


def sanitized_value(variable: Column, value: Column) -> Column:
    """What may be kept of a value: its host, or scheme and host; '' for secrets, indirections and anything else."""
    v = F.trim(F.regexp_replace(F.trim(value), r"^[\"']|[\"'],?$", ""))
    low = F.lower(v)
    away = F.lit(False)
    for m in INDIRECT:
        away = away | F.contains(low, F.lit(m))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    host = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/\s]*@)?\[?([a-z0-9._-]+)\]?(?::[0-9]+)?(?:[/?#,].*)?$", 1)
    wanted = F.upper(variable).rlike("|".join(CONNECTION_WORDS))
    return F.when(away | (host == ""), "").when(scheme != "", F.concat(scheme, F.lit("://"), host)).when(wanted, host).otherwise("")
