"""Attributes of owners: decoding, first-attribute checks, severity and quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cve_list, days, freshness, real, severity_score, when_ms, whole
from ..schema import HAS, Graph


def owned(g: Graph) -> DataFrame:
    """owner, edge_seq, type, value: every attribute with its owner, a plain equi-join."""
    values = g.nodes.where(F.col("type").isNotNull()).select("node_id", "type", "value")
    return g.label(HAS).join(values, F.col("dst") == F.col("node_id")).select(F.col("src").alias("owner"), "edge_seq", "type", "value")


def first(attrs: DataFrame) -> DataFrame:
    """Each owner's attribute of smallest edge_seq; aggregated, so an owner's attributes are not gathered."""
    return attrs.groupBy("owner").agg(F.min_by(F.struct("type", "value"), "edge_seq").alias("a")).select("owner", "a.type", "a.value")


def _present(kind: str, strict: bool) -> Column:
    of_kind = F.col("type") == kind
    if not strict:
        return of_kind
    full = {
        "CVE": F.coalesce(F.size(cve_list(F.col("value"))), F.lit(0)) > 0,
        "FRESHNESS": freshness(F.col("value"))["numberMissedRelease"].isNotNull(),
        "POPULARITY_1_YEAR": F.col("value") != "0",
        "SPEED": F.col("value") != "0",
    }
    return of_kind & full[kind]


def having(g: Graph, kind: str = "CVE", strict: bool = True, scope: str = "first") -> DataFrame:
    """owner: those whose first attribute (or any, by scope) is of a kind, and not empty if strict."""
    attrs = owned(g)
    return (first(attrs) if scope == "first" else attrs).where(_present(kind, strict)).select("owner").distinct()


def with_attributes(g: Graph, scope: str = "first") -> DataFrame:
    """owner: nodes with any known kind of attribute, or a time."""
    kinds = F.col("type").isin("CVE", "FRESHNESS", "POPULARITY_1_YEAR", "SPEED")
    attrs = owned(g)
    held = (first(attrs) if scope == "first" else attrs).where(kinds).select("owner")
    return held.unionByName(g.nodes.where(when_ms(F.col("timestamp")) != 0).select(F.col("node_id").alias("owner"))).distinct()


def severity(g: Graph, scope: str = "first") -> DataFrame:
    """owner, severity, cves: summed scores and number of CVEs over all attributes of owners that pass the type check."""
    entries = owned(g).select("owner", F.explode_outer(cve_list(F.col("value"))).alias("c"))
    sums = entries.groupBy("owner").agg(F.coalesce(F.sum(F.when(F.col("c").isNotNull(), severity_score(F.col("c.severity")))), F.lit(0)).alias("severity"), F.count("c").alias("cves"))
    return having(g, "CVE", strict=False, scope=scope).join(sums, "owner")


def quantities(g: Graph) -> DataFrame:
    """node_id, popularity, missed, outdated_days, speed for every node: the last attribute of a kind, 0 where absent."""
    last = lambda kind, v: F.max_by(v, F.when(F.col("type") == kind, F.col("edge_seq")))
    fresh = freshness(F.col("value"))
    per = owned(g).groupBy("owner").agg(
        last("POPULARITY_1_YEAR", whole(F.col("value"))).alias("popularity"),
        last("FRESHNESS", whole(fresh["numberMissedRelease"])).alias("missed"),
        last("FRESHNESS", whole(fresh["outdatedTimeInMs"])).alias("outdated_ms"),
        last("SPEED", real(F.col("value"))).alias("speed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.nodes.select("node_id").join(per, F.col("node_id") == F.col("owner"), "left").select("node_id", zero("popularity").alias("popularity"), zero("missed").alias("missed"), days(zero("outdated_ms")).alias("outdated_days"), F.coalesce("speed", F.lit(0.0)).alias("speed"))
