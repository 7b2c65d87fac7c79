"""Facts from source text: declarations, relations, routes, endpoints, assignments.

All are regular expressions over lines or whole texts, kept inside the JVM; ``files`` has repository,
path and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import service_name, without_comments

#: What declares a symbol, by language: kind and pattern with the name as group 1.
SYMBOLS = {
    "go": [("function", r"(?m)^func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)[ \t]*[(\[]"), ("type", r"(?m)^type[ \t]+(\w+)[ \t]")],
    "py": [("function", r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\("), ("class", r"(?m)^[ \t]*class[ \t]+(\w+)[ \t]*[:(]")],
    "java": [("class", r"(?m)\b(?:class|interface|enum|record)[ \t]+(\w+)\b[^;\n]*\{"), ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|static|final|synchronized)[ \t]+)+[\w<>\[\], ]+[ \t]+(\w+)[ \t]*\([^)\n]*\)[ \t]*(?:throws[^{\n]*)?\{")],
    "js": [("function", r"(?m)^[ \t]*(?:export[ \t]+)?(?:async[ \t]+)?function[ \t]+(\w+)[ \t]*\("), ("constant", r"(?m)^(?:export[ \t]+)?const[ \t]+(\w+)[ \t]*="), ("class", r"(?m)^[ \t]*(?:export[ \t]+)?class[ \t]+(\w+)\b")],
}
_EXT = r"\.([A-Za-z]+)$"


def _of_kind(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def slim(files: DataFrame, found: Column, name: str) -> DataFrame:
    """Repository, path and what was found of every file, without its text; files delivered twice once."""
    keys = [c for c in ("file_id", "repository", "path") if c in files.columns]
    out = files.select(*keys, found.alias(name))
    return out.distinct() if "file_id" in keys else out


def symbols(files: DataFrame) -> DataFrame:
    """``repository, path, kind, name`` of declarations in files of known languages."""
    ext = F.lower(F.regexp_extract("path", _EXT, 1))
    out = None
    for e, rules in SYMBOLS.items():
        found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _of_kind(k)) for k, p in rules])
        out = F.when(ext == e, found) if out is None else out.when(ext == e, found)
    return slim(files, out, "s").select("repository", "path", F.explode("s").alias("s")).select("repository", "path", "s.kind", "s.name")


def calls(files: DataFrame) -> DataFrame:
    """Names that are called, each once for a file: an identifier or its last part before a parenthesis."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:\w+\.)*(\w+)\("), F.lit(1)))
    words = ["if", "for", "while", "switch", "return", "catch", "func", "function", "def", "print", "elif", "except", "and", "or", "not", "in"]
    return slim(files, names, "names").select("repository", "path", F.explode("names").alias("target")).filter(~F.col("target").isin(words))


def references(lines: DataFrame, symbol: str) -> DataFrame:
    """Lines that name ``symbol`` as a whole identifier."""
    return lines.filter(F.array_contains(F.split("line", r"[^\p{L}\p{Nd}_$]+"), symbol))


def go_routes(files: DataFrame) -> DataFrame:
    pattern = r"""(?:HandleFunc|Handle|Get|Post|Put|Delete|Patch|GET|POST|PUT|DELETE|PATCH)\([ \t]*"((?:[A-Z]+ )?/[^"]*)\""""
    found = slim(files, F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), "rs").select("repository", "path", F.explode("rs").alias("r"))
    return found.select("repository", "path", F.coalesce(F.nullif(F.regexp_extract("r", "^([A-Z]+) ", 1), F.lit("")), F.lit("ANY")).alias("verb"), F.regexp_replace("r", "^[A-Z]+ ", "").alias("route"))


def _route(prefix, path):
    return F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "(?<=/)/+|(?<=.)/+$", "")


def spring_routes(files: DataFrame) -> DataFrame:
    """Class prefix times method paths, and functional routes, which have no prefix."""
    prefix = F.regexp_extract("text", r"""@RequestMapping\((?:value[ ]*=[ ]*)?"([^"]*)"\)[^@{]*class """, 1)
    verbs = F.regexp_extract_all("text", F.lit(r"@(Get|Post|Put|Delete|Patch)Mapping\b"), F.lit(1))
    paths = F.regexp_extract_all("text", F.lit(r"""@(?:Get|Post|Put|Delete|Patch)Mapping(?:\((?:value[ ]*=[ ]*|path[ ]*=[ ]*)?(?:"([^"]*)")?[^)]*\))?"""), F.lit(1))
    plain = F.regexp_extract_all("text", F.lit(r"""\b(?:GET|POST|PUT|DELETE|PATCH)\(\s*"/[^"]*\""""), F.lit(0))
    both = F.struct(prefix.alias("prefix"), F.arrays_zip(verbs.alias("v"), paths.alias("p")).alias("zs"), plain.alias("fs"))
    rows = slim(files, both, "x")
    by_class = rows.select("repository", "path", "x.prefix", F.explode("x.zs").alias("z")).select("repository", "path", F.upper("z.v").alias("verb"), _route(F.col("prefix"), F.coalesce("z.p", F.lit(""))).alias("route"))
    functional = rows.select("repository", "path", F.explode("x.fs").alias("f")).select("repository", "path", F.regexp_extract("f", r"^([A-Z]+)", 1).alias("verb"), _route(F.lit(""), F.regexp_extract("f", r'"([^"]*)"', 1)).alias("route"))
    return by_class.unionByName(functional)


#: Hosts of documentation and schemas, which name no service.
NO_SERVICE = ["localhost", "127.0.0.1", "0.0.0.0", "www.w3.org", "schemas.xmlsoap.org", "www.apache.org", "json-schema.org", "example.com", "www.springframework.org", "maven.apache.org"]


def client_targets(files: DataFrame) -> DataFrame:
    """``repository, path, target`` of declared HTTP clients, and of URLs in files that use a client; each once for a file."""
    text = without_comments(F.col("text"))
    named = F.regexp_extract_all(text, F.lit(r"""@FeignClient\s*\([^)]*?(?:(?:name|value)\s*=\s*)?"([^"]+)"[^)]*\)"""), F.lit(1))
    urls = F.when(text.rlike(r"\b(?:WebClient|RestTemplate|RestClient|HttpClient|OkHttpClient)\b"), F.regexp_extract_all(text, F.lit(r"""\b(?:https?|lb)://([A-Za-z0-9._-]+)"""), F.lit(1)))
    hosts = F.array_distinct(F.concat(named, F.coalesce(urls, F.array().cast("array<string>"))))
    rows = slim(files, hosts, "hosts").select("repository", "path", F.explode("hosts").alias("host")).filter(~F.lower("host").isin(NO_SERVICE))
    return rows.select("repository", "path", service_name(F.col("host")).alias("target")).filter("target <> ''").distinct()


def match_route(calls_: DataFrame, routes: DataFrame) -> DataFrame:
    """Called paths and the route templates they fit, part by part (``{x}``, ``:x`` and ``*`` fit any).

    The equi-key is the number of parts and the first literal part; wildcard-first templates join on the
    number alone.
    """
    parts = lambda c: F.filter(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), lambda x: x != "")
    wild = lambda x: F.startswith(x, F.lit("{")) | F.startswith(x, F.lit(":")) | (x == "*")
    c = calls_.withColumn("cp", parts(F.col("called"))).withColumn("n", F.size("cp")).withColumn("head", F.explode(F.array(F.coalesce(F.try_element_at("cp", F.lit(1)), F.lit("")), F.lit("*"))))
    r = routes.withColumn("rp", parts(F.col("route"))).withColumn("n", F.size("rp"))
    first = F.try_element_at("rp", F.lit(1))
    r = r.withColumn("head", F.when(first.isNull(), "").when(wild(first), "*").otherwise(first))
    fits = F.forall(F.zip_with("cp", "rp", lambda a, b: wild(b) | (a == b)), lambda x: x)
    return c.join(r, ["n", "head"]).filter(fits).select("called", "route").distinct()


def endpoints(lines: DataFrame) -> DataFrame:
    """Service targets in lines: HTTP and database URLs, brokers and remote calls, by protocol and host."""
    url = F.explode(F.regexp_extract_all("line", F.lit(r"\b((?:https?|grpc|kafka|amqps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s\"'`<>)]+)"), F.lit(1)))
    rows = lines.select("repository", "path", "number", url.alias("url"))
    host = F.lower(F.regexp_extract("url", r"^[a-z+]+://(?:[^@/]*@)?\[?([^:/?#\]]+)", 1))
    return rows.select("repository", "path", "number", F.regexp_extract("url", "^([a-z+]+)://", 1).alias("protocol"), host.alias("host")).withColumn("loopback", F.col("host").isin("localhost", "127.0.0.1", "0.0.0.0", "::1"))


def service_lines(lines: DataFrame) -> DataFrame:
    """``repository, path, number, protocol, target`` of lines that call a remote procedure, open a database or serve tools.

    Procedure targets stand in quotes behind a dial, an address or an endpoint setting; database targets
    are the hosts of their URLs; a server of tools is told by what its libraries are called.
    """
    grpc = F.lower(F.regexp_extract("line", r"""(?i)(?:grpc\.(?:dial|newclient)|foraddress|grpc[-_. ]?(?:target|endpoint|host))[^"'`\n]{0,100}["'`]([a-z0-9][a-z0-9._-]*)""", 1))
    scheme = F.lower(F.regexp_extract("line", r"(?i)\b(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|cassandra|neo4j|sqlserver)://", 1))
    host = F.lower(F.regexp_extract("line", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|cassandra|neo4j|sqlserver)://(?:[^@/\s\"'`]*@)?([a-z0-9._-]+)", 1))
    tools = F.lower("line").rlike(r"@modelcontextprotocol/sdk|mcpserver|mcp\.newserver|streamablehttpservertransport")
    item = lambda cond, p, t: F.when(cond, F.struct(p.alias("protocol"), t.alias("target")))
    found = F.filter(F.array(item(grpc != "", F.lit("grpc"), grpc), item(host != "", scheme, host), item(tools, F.lit("mcp"), F.col("repository").cast("string"))), lambda x: x.isNotNull())
    return lines.select("repository", "path", "number", F.explode(found).alias("x")).select("repository", "path", "number", "x.protocol", "x.target")


def assignments(lines: DataFrame) -> DataFrame:
    """``NAME=value`` and ``NAME: value`` lines of configuration; secrets keep the name only."""
    name, value = F.regexp_extract("line", r"^[ \t-]*(?:export[ \t]+|ENV[ \t]+)?([A-Z][A-Z0-9_]{2,})[ \t]*[:=]", 1), F.trim(F.regexp_extract("line", r"^[^:=]*[:=][ \t]*(.*)$", 1))
    secret = name.rlike("(?:SECRET|TOKEN|PASSWORD|PASSWD|PRIVATE|CREDENTIAL|API_?KEY)")
    indirect = value.rlike(r"^\$\{?|^\{\{|valueFrom")
    return lines.withColumn("variable", name).filter("variable <> ''").select("repository", "path", "number", "variable", F.when(secret | indirect, "").otherwise(F.regexp_replace(value, r"^[\"']|[\"']$", "")).alias("value"), indirect.alias("indirect"))
