"""Vulnerability pair tables, causal skeleton and score, and path effects."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import when_ms
from ..schema import Graph
from ..sources.scratch import checkpointed
from .attrs import severity, with_attributes
from .dependencies import two_hops


def cve_features(g: Graph) -> DataFrame:
    """owner, exists, score, num: one row for each owner that passes the type check, an empty list included."""
    return severity(g).select("owner", F.lit(1).alias("exists"), F.col("severity").alias("score"), F.col("cves").alias("num"))


def _both_ends(g: Graph, pairs: DataFrame, one: str, other: str) -> DataFrame:
    feats = checkpointed(cve_features(g))  # both ends read it
    out = pairs
    for end, name in (("source", one), ("target", other)):
        f = feats.select(F.col("owner").alias(end), *[F.col(c).alias(f"{name}_cve_{c}") for c in ("exists", "score", "num")])
        out = out.join(f, end, "left")
    times = g.nodes.select(F.col("node_id").alias("target"), when_ms(F.col("timestamp")).alias("timestamp"))
    filled = [f"{n}_cve_{c}" for n in (one, other) for c in ("exists", "score", "num")]
    out = out.join(times, "target", "left").na.fill(0, [*filled, "timestamp"])
    return out.select("source", "target", *filled, "timestamp")


def one_hop_pairs(g: Graph) -> DataFrame:
    """Features of both ends of every edge; the time is the target's."""
    return _both_ends(g, g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target")), "source", "target")


def two_hop_pairs(g: Graph, scope: str = "first", filtered: bool = True) -> DataFrame:
    hops = two_hops(g, with_attributes(g, scope) if filtered else None)
    return _both_ends(g, hops.select(F.col("artifact").alias("source"), F.col("neighbor").alias("target")), "node", "neighbor")


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square above x), from the regularised incomplete gamma function."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    log = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * math.exp(log))
    tiny, b = 1e-300, z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, math.exp(log) * h)


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def _independent(df: DataFrame, x: str, y: str, given: list[str], level: float, yates: bool) -> bool:
    """Conditional independence by summed chi-square over the strata; counts are made in Spark, a row comes back."""
    cell = df.groupBy(*given, x, y).agg(F.sum("n").alias("__o"))
    s = cell.groupBy(*given) if given else cell.groupBy()
    strata = s.agg(F.sum("__o").alias("__t"), F.countDistinct(x).alias("__r"), F.countDistinct(y).alias("__c"))
    rows, cols = df.groupBy(*given, x).agg(F.sum("n").alias("__rx")), df.groupBy(*given, y).agg(F.sum("n").alias("__cy"))
    grid = (rows.join(cols, given) if given else rows.crossJoin(F.broadcast(cols))).join(cell, [*given, x, y], "left")
    grid = grid.join(strata, given) if given else grid.crossJoin(F.broadcast(strata))
    e = F.col("__rx") * F.col("__cy") / F.col("__t")
    off = F.abs(F.coalesce("__o", F.lit(0)) - e)
    dof = (F.col("__r") - 1) * (F.col("__c") - 1)
    if yates:
        off = F.when(dof == 1, F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))).otherwise(off)
    stat = grid.where(dof > 0).agg(F.sum(off * off / e)).first()[0]
    total = strata.agg(F.sum(dof)).first()[0]
    return chi_square_tail(stat or 0.0, int(total or 0)) >= level


def skeleton(df: DataFrame, columns: list[str], level: float = 0.05, yates: bool = True) -> list[tuple[str, str]]:
    """PC skeleton on discrete columns: an edge goes once some conditioning set among its neighbours makes it independent.

    All tests share one histogram of the columns. Edges point along the order of the columns.
    """
    h = checkpointed(histogram(df, columns))
    near = {c: {d for d in columns if d != c} for c in columns}
    size = 0
    while any(len(near[c]) - 1 >= size for c in columns):
        before = {c: sorted(near[c], key=columns.index) for c in columns}
        for x, y in combinations(columns, 2):
            if y not in near[x]:
                continue
            sets = dict.fromkeys(s for base in (x, y) for s in combinations([c for c in before[base] if c not in (x, y)], size))
            if any(_independent(h, x, y, list(s), level, yates) for s in sets):
                near[x].discard(y)
                near[y].discard(x)
        size += 1
    return [(x, y) for x, y in combinations(columns, 2) if y in near[x]]


def bic(df: DataFrame, edges: list[tuple[str, str]], columns: list[str] | None = None) -> DataFrame:
    """node, score: local BIC of each column given its parents; no row without edges."""
    columns = columns or list(dict.fromkeys(c for e in edges for c in e))
    out, df = None, checkpointed(histogram(df, columns)) if edges else df
    for v in columns if edges else []:
        pa = [x for x, y in edges if y == v]
        joint = df.groupBy(*pa, v).agg(F.sum("n").alias("n"))
        base = joint.groupBy(*pa).agg(F.sum("n").alias("m")) if pa else joint.agg(F.sum("n").alias("m"))
        fit = (joint.join(base, pa) if pa else joint.crossJoin(F.broadcast(base))).agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))).alias("ll"), F.sum("n").alias("total"))
        states = df.agg(F.countDistinct(v).alias("r"), *[F.countDistinct(p).alias(f"q{i}") for i, p in enumerate(pa)])
        q = F.lit(1)
        for i in range(len(pa)):
            q = q * F.col(f"q{i}")
        one = fit.crossJoin(states).select(F.lit(v).alias("node"), (F.col("ll") - F.log("total") / 2 * q * (F.col("r") - 1)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], "node string, score double") if out is None else out


def discover(df: DataFrame, columns: list[str], level: float = 0.05) -> tuple[list[tuple[str, str]], float]:
    """Skeleton and its BIC, 0 without edges."""
    edges = skeleton(df, columns, level)
    return edges, float(bic(df, edges).agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0])


def path_effect(df: DataFrame, y: str = "neighbor_cve_score", x: str = "node_cve_score") -> DataFrame:
    """One-regressor structural model: estimate, standard error, z and residual variance, by maximum likelihood."""
    s = df.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    s = s.withColumn("residual", F.col("vy") - F.try_divide(F.col("c") * F.col("c"), F.col("vx")))
    se = F.sqrt(F.try_divide(F.col("residual"), F.col("n") * F.col("vx")))
    return s.select(F.col("b").alias("estimate"), se.alias("std_err"), F.try_divide(F.col("b"), se).alias("z"), "residual")
