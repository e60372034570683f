"""Feature matrix, correlation, weights, stepwise regression and score standardisation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import freshness, min_max, pearson, whole, z_score
from ..schema import Graph
from ..sources.scratch import checkpointed
from .attrs import quantities, severity, with_attributes
from .degree import in_out

FEATURES = ("freshness_missrelease", "freshness_outdays", "popularity", "speed", "severity")
#: The default scale of weights.
FACTOR = 2776187.0


def feature_matrix(g: Graph, vertices: DataFrame | None = None) -> DataFrame:
    """node_id and features of the nodes with attributes, degrees in the digraph they induce."""
    v = (with_attributes(g).select(F.col("owner").alias("node_id")) if vertices is None else vertices.select("node_id")).join(g.nodes.select("node_id"), "node_id", "left_semi")
    q, s = quantities(g), severity(g).select(F.col("owner").alias("node_id"), "severity")
    out = v.join(q, "node_id").join(s, "node_id", "left").join(in_out(g.edges, v), "node_id")
    return out.select("node_id", F.col("missed").alias("freshness_missrelease"), F.col("outdated_days").alias("freshness_outdays"), "popularity", "speed", F.coalesce("severity", F.lit(0)).alias("severity"), "outdegree", "degree")


def null_profile(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, corr of every pair of columns in one aggregate; null for a constant column."""
    pairs = [(x, y) for x in columns for y in columns]
    one = df.agg(*[pearson(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("corr")) for i, (x, y) in enumerate(pairs)])).alias("r")).select("r.*")


def average_weight(df: DataFrame, features: list[str] | None = None, target: str = "outdegree", factor: float = FACTOR) -> DataFrame:
    """Adds weight: features weighted by their share of absolute correlation with the target (equal if there is none), scaled to 0..factor."""
    features, df = list(features or FEATURES), checkpointed(df)  # read three times
    one = df.agg(*[F.coalesce(F.abs(pearson(f, target)), F.lit(0.0)).alias(f"__c{i}") for i, f in enumerate(features)])
    total = sum((F.col(f"__c{i}") for i in range(len(features))), F.lit(0.0))
    one = one.select(*[F.when(total > 0, F.col(f"__c{i}") / total).otherwise(1.0 / len(features)).alias(f"__w{i}") for i in range(len(features))])
    raw = df.crossJoin(F.broadcast(one)).select(*df.columns, sum((F.col(f) * F.col(f"__w{i}") for i, f in enumerate(features)), F.lit(0.0)).alias("__raw"))
    span = raw.agg(F.min("__raw").alias("__lo"), F.max("__raw").alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), min_max(F.col("__raw"), F.col("__lo"), F.col("__hi")) * factor).otherwise(F.col("__raw"))
    return raw.crossJoin(F.broadcast(span)).select(*df.columns, scaled.alias("weight"))


def correlated_weight(df: DataFrame, features: list[str] | None = None, target: str | None = "outdegree") -> DataFrame:
    """Adds weight: the sum of features times their correlation with the target; with target None with themselves, which is 1 or, for a constant, null."""
    features, df = list(features or FEATURES), checkpointed(df)  # read twice
    one = df.agg(*[pearson(f, target or f).alias(f"__c{i}") for i, f in enumerate(features)])
    terms = [F.coalesce(F.col(f"__c{i}"), F.lit(0.0)) if target else F.col(f"__c{i}") for i in range(len(features))]
    return df.crossJoin(F.broadcast(one)).select(*df.columns, sum((F.col(f) * t for f, t in zip(features, terms)), F.lit(0.0)).alias("weight"))


def moments(df: DataFrame, columns: list[str]):
    """Rows and the cross products of a constant and the columns, over finite rows, in one aggregate."""
    from ..functions.scalar import finite

    names = ["1", *columns]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    clean = df.where(finite(*[F.col(c).cast("double") for c in columns]))
    row = clean.agg(*[F.sum(col(a) * col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    out = [[0.0] * len(names) for _ in names]
    for i in range(len(names)):
        for j in range(i, len(names)):
            out[i][j] = out[j][i] = float(row[f"s{i}_{j}"] or 0.0)
    return names, out


def _inverse(m: list[list[float]]) -> list[list[float]] | None:
    n = len(m)
    a = [[*map(float, r), *(1.0 if i == j else 0.0 for j in range(n))] for i, r in enumerate(m)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        if abs(a[p][c]) < 1e-9 * max(1.0, max(abs(x) for x in m[c])):
            return None
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c])]
    return [r[n:] for r in a]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def ols(m: list[list[float]], y: int, xs: list[int]) -> tuple[list[float], list[float], float] | None:
    """Coefficients, p-values and R^2 of y on a constant and xs, from cross products; None if singular."""
    at = [0, *xs]
    inv = _inverse([[m[i][j] for j in at] for i in at])
    n = m[0][0]
    if inv is None or n <= len(at):
        return None
    beta = [sum(inv[r][c] * m[at[c]][y] for c in range(len(at))) for r in range(len(at))]
    rss = max(m[y][y] - sum(b * m[k][y] for b, k in zip(beta, at)), 0.0)
    tss = m[y][y] - m[0][y] ** 2 / n
    s2 = rss / (n - len(at))
    ps = [t_tail(b / math.sqrt(s2 * inv[k][k]), n - len(at)) if s2 * inv[k][k] > 0 else 0.0 for k, b in enumerate(beta)]
    return beta, ps, 1 - rss / tss if tss > 0 else 0.0


def stepwise(df: DataFrame, threshold: float = 0.05, features: list[str] | None = None, target: str = "outdegree") -> list[str]:
    """Forward selection: in each round the eligible feature (p below the threshold) of best R^2; ties keep the earlier. One pass over the rows."""
    features = list(features or FEATURES)
    names, m = moments(df, [*features, target])
    y, chosen = names.index(target), []
    while True:
        best: tuple[float, str] | None = None
        for f in features:
            fit = None if f in chosen else ols(m, y, [names.index(x) for x in [*chosen, f]])
            if fit and fit[1][-1] < threshold and (best is None or fit[2] > best[0]):
                best = (fit[2], f)
        if best is None:
            return chosen
        chosen.append(best[1])


def freshness_score(values: DataFrame) -> DataFrame:
    """value -> score: missed releases and outdated time, each min-max scaled, half and half."""
    f = freshness(F.col("value"))
    x = values.select("value", whole(f["numberMissedRelease"]).alias("m"), whole(f["outdatedTimeInMs"]).alias("t")).where("m is not null and t is not null")
    s = x.agg(F.min("m").alias("m0"), F.max("m").alias("m1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return x.crossJoin(F.broadcast(s)).select("value", (0.5 * min_max(F.col("m"), F.col("m0"), F.col("m1")) + 0.5 * min_max(F.col("t"), F.col("t0"), F.col("t1"))).alias("score"))


def standardised(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(measure, node, score) with z, over each measure's own list, population deviation."""
    keys = by or ["measure"]
    s = scores.groupBy(*keys).agg(F.avg("score").alias("__m"), F.stddev_pop("score").alias("__s"))
    return scores.join(F.broadcast(s), keys).withColumn("z", z_score(F.col("score"), F.col("__m"), F.col("__s"))).drop("__m", "__s")


def aligned(scores: DataFrame, measures: list[str], value: str = "score") -> DataFrame:
    """A row for each node and a column for each measure, 0 where it is missing."""
    return scores.groupBy("node").pivot("measure", measures).agg(F.first(value)).na.fill(0.0, measures)


def combined(scores: DataFrame, measures: list[str], k: int = 10) -> DataFrame:
    """node, total: summed standard scores of the top lists, the k largest."""
    wide = aligned(standardised(scores), measures, "z")
    return wide.select("node", sum((F.col(m) for m in measures), F.lit(0.0)).alias("total")).orderBy(F.desc("total"), "node").limit(k)
