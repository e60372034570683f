"""The package graph that the order tables stand for, for queries where no package graph is supplied.

Parts are artifacts, orders with lines are releases of their smallest part, other parts of an order are its
dependencies; returned lines are vulnerabilities. Attribute values are rendered as the escaped JSON and number texts
that a package graph has, so that decoding is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADDED, ARTIFACT, HAS, NEEDS, OWNS, RELEASE, Graph
from .graph import read_parquet, write_parquet
from .scratch import kept

SEVERITIES = ("CRITICAL", "HIGH", "MODERATE", "LOW", "WEIRD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _ms(c: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, ts, owner, n (lines), quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_partkey").alias("owner"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), _ms("o_orderdate").alias("ts")).join(lines, "o")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner (node), num (its number), k (its place), type, value."""
    rel, lines = releases(spark, sf_dir), table(spark, sf_dir, "lineitem")
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    entry = text('{"cwe":"[CWE-', F.col("l_linenumber").cast("string"), ",CWE-", (F.col("l_suppkey") % 7 + 20).cast("string"), ']","severity":"', severity, '","name":"CVE-', F.col("l_suppkey").cast("string"), '"}')
    listed = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", entry.alias("e")))).alias("es"))
    escaped = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    cves = rel.join(listed, "o", "left").where(F.col("es").isNotNull() | (F.col("o") % 3 == 0))
    body = F.coalesce(F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit(""))
    owner, num = _id("r", "o").alias("owner"), F.col("o").alias("num")
    parts = lines.groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("n"))
    speed = F.floor(F.col("n") * 1000 / F.lit(365)).cast("bigint")
    return (
        cves.select(owner, num, F.lit(1).alias("k"), F.lit("CVE").alias("type"), escaped(text('{"cve":[', body, "]}")).alias("value"))
        .unionByName(rel.where("o % 2 = 0").select(owner, num, F.when(F.col("o") % 4 == 0, 0).otherwise(2).alias("k"), F.lit("FRESHNESS").alias("type"), escaped(text('{"freshness":{"numberMissedRelease":"', F.col("n").cast("string"), '","outdatedTimeInMs":"', (F.col("o") * 7919 % 1000 * 3600000).cast("string"), '"}}')).alias("value")))
        .unionByName(rel.where("o % 5 = 0").select(owner, num, F.lit(3).alias("k"), F.lit("POPULARITY_1_YEAR").alias("type"), F.col("quantity").cast("string").alias("value")))
        .unionByName(parts.where("p % 2 = 0").select(_id("a", "p").alias("owner"), F.col("p").alias("num"), F.lit(4).alias("k"), F.lit("SPEED").alias("type"), F.concat((speed / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((speed % 1000).cast("string"), 3, "0")).alias("value")))
    )


def package_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, made once and then read from its written form."""
    path = kept(spark, "package-graph", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")], lambda to: write_parquet(make_package_graph(spark, sf_dir), to))
    return read_parquet(spark, path)


def make_package_graph(spark: SparkSession, sf_dir: str) -> Graph:
    rel, none = releases(spark, sf_dir), F.lit(None).cast("string")
    added = attributes(spark, sf_dir)
    value_id = F.concat("owner", F.lit(":v"), F.col("k").cast("string"))
    artifacts = table(spark, sf_dir, "part").select((F.col("p_partkey") * 16).alias("node_seq"), _id("a", "p_partkey").alias("node_id"), F.lit(ARTIFACT).alias("labels"), _id("grp:a", "p_partkey").alias("id"), none.alias("version"), none.alias("timestamp"), none.alias("type"), none.alias("value"))
    released = rel.select((F.col("o") * 16 + (1 << 50)).alias("node_seq"), _id("r", "o").alias("node_id"), F.lit(RELEASE).alias("labels"), F.concat(_id("grp:a", "owner"), F.lit(":"), F.col("o").cast("string")).alias("id"), F.col("o").cast("string").alias("version"), F.col("ts").cast("string").alias("timestamp"), none.alias("type"), none.alias("value"))
    values = added.select((F.col("num") * 16 + F.col("k") + (1 << 51)).alias("node_seq"), value_id.alias("node_id"), F.lit(ADDED).alias("labels"), F.concat("owner", F.lit(":"), "type").alias("id"), none.alias("version"), none.alias("timestamp"), "type", "value")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    needs = parts.join(rel.select("o", "owner"), "o").where("p <> owner")
    edges = (
        added.select((F.col("num") * 16 + F.col("k")).alias("edge_seq"), F.col("owner").alias("src"), value_id.alias("dst"), F.lit(HAS).alias("label"))
        .unionByName(needs.select((F.col("o") * (1 << 28) + F.col("p") + (1 << 58)).alias("edge_seq"), _id("r", "o").alias("src"), _id("a", "p").alias("dst"), F.lit(NEEDS).alias("label")))
        .unionByName(rel.select((F.col("o") + (1 << 61)).alias("edge_seq"), _id("a", "owner").alias("src"), _id("r", "o").alias("dst"), F.lit(OWNS).alias("label")))
    )
    return Graph(artifacts.unionByName(released).unionByName(values), edges)


def _made(spark: SparkSession, sf_dir: str, name: str, tables: list[str], make) -> DataFrame:
    return spark.read.parquet(kept(spark, name, [f"{sf_dir}/{t}.parquet" for t in tables], lambda to: make(spark, sf_dir).write.parquet(to)))


def cve_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(release, name, cwe_ids): a vulnerability document's rows, from returned lines; some names are UNKNOWN."""
    return _made(spark, sf_dir, "cve-entries", ["lineitem", "orders"], make_cve_entries)


def make_cve_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(releases(spark, sf_dir).select("o", "owner"), F.col("l_orderkey") == F.col("o"))
    name = F.when(F.col("l_suppkey") % 50 == 0, "UNKNOWN").otherwise(_id("CVE-", "l_suppkey"))
    cwe = F.when(F.col("l_suppkey") % 50 == 0, "UNKNOWN").otherwise(F.concat(F.lit("[CWE-"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).cast("string"), F.lit(",CWE-"), (F.col("l_suppkey") % 7 + 20).cast("string"), F.lit("]")))
    return lines.select(F.concat(_id("grp:a", "owner"), F.lit(":"), F.col("o").cast("string")).alias("release"), name.alias("name"), cwe.alias("cwe_ids"))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, cents of nations whose trade is above the mean: a small digraph with at most a node for each nation."""
    return _above_mean(_made(spark, sf_dir, "trade", ["lineitem", "orders", "customer", "supplier"], make_trade))


def region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between the nations' regions."""
    n = table(spark, sf_dir, "nation")
    of = lambda c: n.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(f"{c}_region"))
    t = _made(spark, sf_dir, "trade", ["lineitem", "orders", "customer", "supplier"], make_trade)
    return _above_mean(t.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("src_region").alias("src"), F.col("dst_region").alias("dst")).agg(F.sum("cents").alias("cents")))


def make_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, cents of each two nations with trade."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


def _above_mean(pairs: DataFrame) -> DataFrame:
    mean = pairs.agg((F.sum("cents") / F.count("*")).alias("mean"))
    return pairs.crossJoin(F.broadcast(mean)).where("cents > mean AND src <> dst").select("src", "dst", "cents")
