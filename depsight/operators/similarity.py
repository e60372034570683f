"""Vulnerability documents: inverted indexes, counts and Jaccard similarity over shared members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cwe_ids, jaccard, without_last
from ..sources.scratch import checkpointed

THRESHOLDS = [k / 10 for k in range(1, 10)]


def packages(entries: DataFrame) -> DataFrame:
    """(release, name, cwe_ids) with releases merged to packages."""
    return entries.withColumn("release", without_last(F.col("release")))


def cve_packs(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("name").alias("key"), F.col("release").alias("member"))


def cwe_packs(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(cwe_ids(F.col("cwe_ids"))).alias("key"), F.col("release").alias("member"))


def cwe_cves(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(cwe_ids(F.col("cwe_ids"))).alias("key"), F.col("name").alias("member"))


def counts(index: DataFrame) -> DataFrame:
    """key, n: members with repeats."""
    return index.groupBy("key").agg(F.count("*").alias("n"))


def lists(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("members"))


def set_sizes(index: DataFrame) -> DataFrame:
    """a, b, both, na, nb of keys that share a member, a < b: an equi-join on the member, counted, and their own sizes."""
    sets = checkpointed(index.distinct())
    sizes = sets.groupBy("key").agg(F.count("*").alias("n"))
    x, y = sets.select(F.col("key").alias("a"), "member"), sets.select(F.col("key").alias("b"), "member")
    both = x.join(y, "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    na, nb = sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), sizes.select(F.col("key").alias("b"), F.col("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", "both", "na", "nb")


def pairs(index: DataFrame) -> DataFrame:
    """a, b, sim of keys that share a member, a < b."""
    return set_sizes(index).select("a", "b", jaccard(F.col("both"), F.col("na"), F.col("nb")).alias("sim"))


def ascending(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """The k rows of smallest value, ties by name, with their place."""
    small = df.orderBy(value, name).limit(k)
    return small.withColumn("place", F.row_number().over(Window.orderBy(value, name)).cast("bigint"))  # k rows


def thresholds(index: DataFrame, at: list[float] | None = None) -> DataFrame:
    """threshold, above, total, percent: all pairs of keys counted by formula, similar ones once for all thresholds."""
    at = at or THRESHOLDS
    n = index.select("key").distinct().agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("total"))
    sims = pairs(index).agg(*[F.coalesce(F.sum((F.col("sim") > t).cast("bigint")), F.lit(0)).alias(f"c{i}") for i, t in enumerate(at)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("above")) for i, t in enumerate(at)]))
    return sims.crossJoin(F.broadcast(n)).select(rows.alias("r"), "total").select("r.threshold", "r.above", "total", (F.try_divide(F.col("r.above"), F.col("total")) * 100).alias("percent"))


def ecosystem(name, order: list[tuple[str, str]], default: str = "Maven"):
    """The first ecosystem whose mark the name holds."""
    out = F.lit(default)
    for mark, eco in reversed(order):
        out = F.when(name.contains(mark), eco).otherwise(out)
    return out


def ecosystem_stats(entries: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """eco, releases, mean, median, max, min of CVEs per release."""
    per = entries.groupBy("release").agg(F.count("*").alias("n")).withColumn("eco", ecosystem(F.col("release"), order))
    return per.groupBy("eco").agg(F.count("*").alias("releases"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("max"), F.min("n").alias("min"))


def within_spread(per: DataFrame, value: str) -> DataFrame:
    """Rows not above the estimated upper fence: quartiles taken one deviation from the mean."""
    s = per.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    q1, q3 = F.col("__m") - F.col("__s"), F.col("__m") + F.col("__s")
    return per.crossJoin(F.broadcast(s)).where(F.col(value) <= q3 + 1.5 * (q3 - q1)).select(per.columns)
