"""Names resolved in tiers: configuration placeholders, client references, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import service_name
from .topology import top_ranked

#: Ranks of roles, the greater the more they may do.
ROLES = {"viewer": 1, "editor": 2, "admin": 3}


def resolve_placeholders(placeholders: DataFrame, registry: DataFrame, assignments: DataFrame) -> DataFrame:
    """The value of each placeholder by the first tier that has one, with the tier or why there is none.

    ``placeholders``: source, variable, default_value, map_key; ``registry``: map_key, value;
    ``assignments``: variable, value, rank.  Tiers: the map key's registered value, the default given in
    place, the assignments of the greatest rank if they agree, and the shape of the name
    (``ORDERS_SERVICE_HOST`` names ``orders``).  Every join is on an equi-key and none multiplies rows.
    """
    reg = registry.groupBy("map_key").agg(F.count_distinct("value").alias("_rn"), F.min("value").alias("_rv"))
    asg = assignments.select(F.lower("variable").alias("_var"), "value", "rank").filter("value <> ''")
    best = top_ranked(asg, ["_var"], "rank").groupBy("_var").agg(F.count_distinct("value").alias("_an"), F.min("value").alias("_av"))
    named = F.regexp_replace(F.lower(F.regexp_extract("variable", r"(?i)^(.+?)_(?:SERVICE_)?(?:URL|URI|HOST|ADDR|ADDRESS|ENDPOINT|BASE_URL)$", 1)), "_", "-")
    j = placeholders.join(reg, "map_key", "left").withColumn("_var", F.lower("variable")).join(best, "_var", "left").withColumn("_shape", named)
    default = F.coalesce(F.col("default_value"), F.lit("")) != ""
    tier = F.when(F.col("_rn") == 1, "registry").when(default, "default").when(F.col("_an") == 1, "assignment").when(F.col("_an") > 1, "ambiguous_assignment").when(F.col("_rn") > 1, "ambiguous_registry").when(F.col("_shape") != "", "name").otherwise("unresolved")
    value = F.when(tier == "registry", F.col("_rv")).when(tier == "default", F.col("default_value")).when(tier == "assignment", F.col("_av")).when(tier == "name", F.col("_shape"))
    return j.select("source", "variable", tier.alias("tier"), service_name(value).alias("target"))


def client_references(references: DataFrame, services: DataFrame) -> DataFrame:
    """Calls between services: known targets only, none to oneself, high evidence instead of low.

    ``references``: source, target, confidence; ``services``: name.
    """
    known = services.select(service_name(F.col("name")).alias("target")).distinct()
    r = references.select(service_name(F.col("source")).alias("source"), service_name(F.col("target")).alias("target"), (F.col("confidence") == "high").cast("int").alias("high"))
    kept = r.filter("source <> target and target <> ''").join(known, "target", "left_semi")
    return kept.groupBy("source", "target").agg(F.max("high").alias("_h"), F.count_if(F.col("high") == 1).alias("_nh"), F.count("*").alias("_n")).select("source", "target", F.when(F.col("_h") == 1, "high").otherwise("low").alias("confidence"), F.when(F.col("_h") == 1, F.col("_nh")).otherwise(F.col("_n")).alias("evidence"))


def effective_roles(identities: DataFrame, memberships: DataFrame, group_roles: DataFrame, provider_groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """The greatest of one's own role, the roles of one's groups, and those mapped from provider groups.

    ``identities``: id, role; ``memberships``: id, group_id; ``group_roles``: group_id, role;
    ``provider_groups``: id, name; ``mapping``: name, role (names compare folded).
    """
    table = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    rank = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0))
    own = identities.select("id", rank("role").alias("r"))
    member = memberships.join(group_roles, "group_id").select("id", rank("role").alias("r"))
    mapped = provider_groups.select("id", F.lower("name").alias("n")).join(mapping.select(F.lower("name").alias("n"), "role"), "n").select("id", rank("role").alias("r"))
    names = F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (v, k)])
    all_ = own.unionByName(member).unionByName(mapped).join(identities.select("id"), "id", "left_semi")
    return all_.groupBy("id").agg(F.max("r").alias("r")).select("id", F.coalesce(F.try_element_at(names, F.col("r")), F.lit("none")).alias("role"))


def message_edges(lines: DataFrame) -> DataFrame:
    """Topics that files publish to or consume from; consuming turns the edge around.

    ``lines``: repository, path, number, line.  Only files with a broker marker anywhere count.
    """
    marked = lines.filter(F.lower("line").rlike(r"kafka|broker|topic")).select("repository", "path").distinct()
    topic = F.lower(F.regexp_extract("line", r"""(?i)(?:topics?|subscribe|send|produce|publish)\w*\s*[(:=\[]+\s*["']([A-Za-z0-9._-]+)["']""", 1))
    consume = F.lower("line").rlike(r"listener|subscribe|consum")
    rows = lines.withColumn("topic", topic).filter("topic <> ''").join(marked, ["repository", "path"], "left_semi")
    return rows.select(F.when(consume, F.col("topic")).otherwise(F.col("repository")).alias("source"), F.when(consume, F.col("repository")).otherwise(F.col("topic")).alias("target"), "path", "number")


def root_reasons(components: DataFrame) -> DataFrame:
    """Why a candidate component is left out, or kept.

    ``components``: name, path, has_source, external, references.
    """
    low = F.lower("name")
    reason = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(low.rlike(r"^(?:test|tests|example|examples|demo|sample|fixture)s?(?:-|$)") | F.lower("path").rlike(r"(?:^|/)(?:test|tests|testdata|examples?|fixtures?)(?:/|$)"), "test or example")
        .when(low.rlike(r"^(?:localhost|127\.|0\.0\.0\.0|::1)"), "loopback").when(F.col("external") & (F.col("references") == 0), "orphaned external").when(~F.col("external") & ~F.col("has_source"), "no deployable source").otherwise("kept")
    )
    return components.withColumn("reason", reason)
