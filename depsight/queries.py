"""Registered queries: a key for each operator, with its SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as O
from .functions import scalar as S
from .operators import attrs, causal, centrality, degree, dependencies, paths, similarity, stats
from .plans import drivers
from .schema import ARTIFACT, NEEDS, OWNS, RELEASE, Graph
from .sources import graph as io
from .sources.adapter import cve_entries, package_graph, region_graph, table, trade_graph
from .sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, on: Callable | None = None):
    """on: what the function is given instead of (spark, sf_dir)."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf_dir: f(on(spark, sf_dir))) if on else f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_graph(name: str, body: str | None = None):
    return register(name, O.graph(body) if body else None, package_graph)


def on_doc(name: str, body: str | None = None, more: str = ""):
    return register(name, O.doc(body, more) if body else None, cve_entries)


def on_trade(name: str, body: str | None = None, more: str = ""):
    return register(name, O.trade(body, more) if body else None, trade_graph)


# ---- sources and sinks

COUNT_NODES = "SELECT labels, count(*) AS n, count(value) AS with_value, count(timestamp) AS timed FROM nodes GROUP BY labels"


@on_graph("s15_graph_nodes", COUNT_NODES)
def s15(g: Graph) -> DataFrame:
    return g.nodes.groupBy("labels").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count("timestamp").alias("timed"))


@on_graph("s15_graph_edges", "SELECT label, count(*) AS n, count(DISTINCT edge_seq) AS seqs FROM edges GROUP BY label")
def s15e(g: Graph) -> DataFrame:
    return g.edges.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("edge_seq").alias("seqs"))


@register("s1_graphml_round_trip", O.graph("SELECT node_id, labels, id, type, value FROM nodes WHERE labels = ':AddedValue'"))
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graphml")
    io.write_graphml(package_graph(spark, sf_dir), path)
    return io.read_graphml(spark, f"{path}/*").nodes.where("labels = ':AddedValue'").select("node_id", "labels", "id", "type", "value")


@register("s1_graphml_edges", O.graph("SELECT src, dst, label FROM edges"))
def s1e(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graphml")
    io.write_graphml(package_graph(spark, sf_dir), path)
    return io.read_graphml(spark, f"{path}/*").edges.select("src", "dst", "label")


@register("s2_parquet_cache", O.graph("SELECT edge_seq, src, dst, label FROM edges WHERE label = 'relationship_AR'"))
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graph")
    io.write_parquet(package_graph(spark, sf_dir), path)
    return io.read_parquet(spark, path).label(OWNS).select("edge_seq", "src", "dst", "label")


@register("s4_materialized", O.graph("SELECT label, count(*) AS n FROM edges GROUP BY label"))
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cache")
    make = lambda: package_graph(spark, sf_dir).edges.groupBy("label").agg(F.count("*").alias("n"))
    io.materialized(spark, path, make)
    return io.materialized(spark, path, make)


@register("s5_csv_round_trip", O.graph("SELECT node_id, outdegree, degree, severity FROM fea"))
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    io.write_csv(stats.feature_matrix(package_graph(spark, sf_dir)).select("node_id", "outdegree", "degree", "severity"), path)
    return io.read_csv(spark, path, "node_id string, outdegree bigint, degree bigint, severity bigint")


@register("s7_string_csv", O.graph("SELECT id, type, value FROM nodes WHERE type IS NOT NULL"))
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    io.write_csv(package_graph(spark, sf_dir).nodes.where("type is not null").select("id", "type", "value"), path)
    return io.read_strings(spark, path)


@register("s8_header", "SELECT unnest(['id', 'type', 'value']) AS name")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    io.write_csv(package_graph(spark, sf_dir).nodes.select("id", "type", "value"), path)
    return spark.createDataFrame([(c,) for c in io.header(spark, path)], "name string")


@register("s9_cve_document", O.doc("SELECT release, name, cwe_ids FROM doc"))
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    entries = cve_entries(spark, sf_dir).groupBy("release").agg(F.collect_list(F.struct("name", "cwe_ids")).alias("c"))
    lines = entries.select(F.to_json(F.map_from_arrays(F.array("release"), F.array("c"))).alias("value"))
    lines.write.text(path)
    return spark.read.text(path).select(F.from_json("value", "map<string, array<struct<name: string, cwe_ids: string>>>").alias("m")).select(F.explode("m").alias("release", "c")).select("release", F.inline("c"))


# ---- projections


@on_graph("r1_select", "SELECT node_id, type FROM nodes WHERE labels = ':AddedValue'")
def r1(g: Graph) -> DataFrame:
    return g.kind(":AddedValue").select("node_id", "type")


@on_graph("r2_drop", "SELECT node_id, labels, id FROM nodes WHERE labels = ':Artifact'")
def r2(g: Graph) -> DataFrame:
    return g.kind(ARTIFACT).drop("node_seq", "version", "timestamp", "type", "value")


@on_graph("r5_mask", "SELECT type, CASE WHEN value LIKE '%[]%' THEN 'blank' ELSE type END AS masked, count(*) AS n FROM nodes WHERE type IS NOT NULL GROUP BY ALL")
def r5(g: Graph) -> DataFrame:
    x = g.nodes.where("type is not null").withColumn("masked", F.when(F.col("value").contains("[]"), "blank").otherwise(F.col("type")))
    return x.groupBy("type", "masked").agg(F.count("*").alias("n"))


@on_graph("r6_positional_slice", "SELECT node_id, row_number() OVER (ORDER BY node_seq) - 1 AS pos FROM nodes WHERE labels = ':Artifact' QUALIFY pos >= 10 AND pos < 50")
def r6(g: Graph) -> DataFrame:
    return io.numbered(g.kind(ARTIFACT).select("node_id", "node_seq"), "pos", "node_seq").where("pos >= 10 and pos < 50").select("node_id", "pos")


@on_graph("r7_head", "SELECT node_id FROM nodes ORDER BY node_seq LIMIT 10")
def r7(g: Graph) -> DataFrame:
    return g.nodes.orderBy("node_seq").limit(10).select("node_id")


@on_graph("r8_json_rows", """SELECT '{"node_id":"' || node_id || '","labels":"' || labels || '"}' AS row FROM nodes WHERE labels = ':Artifact'""")
def r8(g: Graph) -> DataFrame:
    return g.kind(ARTIFACT).select(F.to_json(F.struct("node_id", "labels")).alias("row"))


@on_graph("r11_null_profile", "SELECT count(*) - count(version) AS version, count(*) - count(timestamp) AS timestamp, count(*) - count(type) AS type, count(*) - count(value) AS value FROM nodes")
def r11(g: Graph) -> DataFrame:
    return stats.null_profile(g.nodes.select("version", "timestamp", "type", "value"))


@on_graph("r12_row_count", "SELECT count(*) AS n FROM edges")
def r12(g: Graph) -> DataFrame:
    return g.edges.agg(F.count("*").alias("n"))


@on_graph("r13_adjacency", "SELECT src, array_to_string(list_sort(list(dst)), ' ') AS targets FROM edges WHERE label = 'dependency' GROUP BY src")
def r13(g: Graph) -> DataFrame:
    return dependencies.adjacency(g.label(NEEDS)).select("src", F.array_join("targets", " ").alias("targets"))


# ---- predicates


@on_graph("p1_releases", "SELECT node_id FROM nodes WHERE labels = ':Release'")
def p1(g: Graph) -> DataFrame:
    return g.kind(RELEASE).select("node_id")


@on_graph("p3_cve_releases", "SELECT node_id FROM nodes WHERE labels = ':Release' AND node_id IN (SELECT owner FROM strict)")
def p3(g: Graph) -> DataFrame:
    return g.kind(RELEASE).join(attrs.having(g), F.col("node_id") == F.col("owner"), "left_semi").select("node_id")


@on_graph("p4_strict_first", "SELECT owner FROM strict")
def p4(g: Graph) -> DataFrame:
    return attrs.having(g)


@on_graph("p4_strict_any", "SELECT owner FROM strict_any")
def p4a(g: Graph) -> DataFrame:
    return attrs.having(g, scope="any")


@on_graph("p5_type_only", "SELECT owner FROM typed")
def p5(g: Graph) -> DataFrame:
    return attrs.having(g, strict=False)


for _n, _kind in (("p6_popularity", "POPULARITY_1_YEAR"), ("p7_speed", "SPEED"), ("p8_freshness", "FRESHNESS")):
    on_graph(f"{_n}_any", f"SELECT DISTINCT owner FROM att WHERE type = '{_kind}' AND value <> '0'")(lambda g, k=_kind: attrs.having(g, k, scope="any"))
    on_graph(f"{_n}_first", f"SELECT owner FROM fst WHERE type = '{_kind}'")(lambda g, k=_kind: attrs.having(g, k, strict=False))


@on_graph("p10_with_attributes", "SELECT owner FROM withattr")
def p10(g: Graph) -> DataFrame:
    return attrs.with_attributes(g)


@on_graph("p13_decoded_filter", "SELECT owner, edge_seq, n FROM cvx WHERE type = 'CVE' AND n > 1")
def p13(g: Graph) -> DataFrame:
    x = attrs.owned(g).where("type = 'CVE'").withColumn("n", F.size(S.cve_list(F.col("value"))).cast("bigint"))
    return x.where("n > 1").select("owner", "edge_seq", "n")


@on_graph("p15_null_filter", "SELECT labels, count(*) AS n FROM nodes WHERE timestamp IS NOT NULL GROUP BY labels")
def p15(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("timestamp").isNotNull()).groupBy("labels").agg(F.count("*").alias("n"))


@register("p16_finite_rows", "SELECT count(*) AS n FROM (SELECT ln(o_totalprice - 1000) AS x FROM orders WHERE o_totalprice > 1000) WHERE isfinite(x)")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("o_totalprice") > 1000, F.log(F.col("o_totalprice") - 1000))
    return table(spark, sf_dir, "orders").where(S.finite(x)).agg(F.count("*").alias("n"))


@on_graph("p18_dependency_or_ownership", "SELECT src, dst FROM edges WHERE label IN ('dependency', 'relationship_AR')")
def p18(g: Graph) -> DataFrame:
    return dependencies.ownership_edges(g)


SIMS = "ks AS (SELECT DISTINCT cwe AS key, release AS member FROM cwe), sz AS (SELECT key, count(*) AS n FROM ks GROUP BY key), bo AS (SELECT x.key AS a, y.key AS b, count(*) AS c FROM ks x JOIN ks y USING (member) WHERE x.key < y.key GROUP BY ALL), sims AS (SELECT a, b, c::DOUBLE / (p.n + q.n - c) AS sim FROM bo JOIN sz p ON a = p.key JOIN sz q ON b = q.key)"


@on_doc("p19_similar_pairs", "SELECT a, b FROM sims WHERE sim > 0.2", SIMS)
def p19(d: DataFrame) -> DataFrame:
    return similarity.pairs(similarity.cwe_packs(d)).where("sim > 0.2").select("a", "b")


@on_graph("p21_drop_label", "SELECT value, count(*) AS n FROM nodes WHERE type = 'FRESHNESS' AND value NOT LIKE '%Release\\\":\\\"1\\\"%' GROUP BY value")
def p21(g: Graph) -> DataFrame:
    return g.nodes.where("type = 'FRESHNESS'").where(~F.col("value").contains('Release\\":\\"1\\"')).groupBy("value").agg(F.count("*").alias("n"))


@on_doc("p22_within_spread", "SELECT release, n FROM per, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM per) WHERE n <= m + s + 1.5 * (2 * s)", "per AS (SELECT release, count(*) AS n FROM doc GROUP BY release)")
def p22(d: DataFrame) -> DataFrame:
    return similarity.within_spread(d.groupBy("release").agg(F.count("*").alias("n")), "n")


# ---- joins


@on_graph("j1_owned_attributes", "SELECT owner, edge_seq, type, value FROM att")
def j1(g: Graph) -> DataFrame:
    return attrs.owned(g)


@on_graph("j2_edge_sources", "SELECT n.labels, e.label, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.node_id GROUP BY ALL")
def j2(g: Graph) -> DataFrame:
    return g.edges.join(g.nodes.select("node_id", "labels"), F.col("src") == F.col("node_id")).groupBy("labels", "label").agg(F.count("*").alias("n"))


@on_graph("j3_one_hop_expansion", "SELECT edge_seq, src, dst, label FROM edges SEMI JOIN strict ON src = owner UNION SELECT edge_seq, src, dst, label FROM edges SEMI JOIN strict ON dst = owner")
def j3(g: Graph) -> DataFrame:
    return paths.expanded(g.edges, attrs.having(g).select(F.col("owner").alias("node_id"))).select("edge_seq", "src", "dst", "label")


@on_trade("j3_sequential_expansion", "SELECT seq AS edge_seq, src::BIGINT AS src, dst::BIGINT AS dst FROM scan WHERE hit", """ord AS (SELECT src * 100 + dst AS seq, src, dst, row_number() OVER (ORDER BY src * 100 + dst) AS k FROM trade),
scan AS (
  SELECT 0::BIGINT AS k, NULL::INT AS seq, NULL::INT AS src, NULL::INT AS dst, [3] AS live, false AS hit
  UNION ALL
  SELECT o.k, o.seq, o.src, o.dst, CASE WHEN list_contains(live, o.src) OR list_contains(live, o.dst) THEN list_distinct(list_concat(live, [o.src, o.dst])) ELSE live END,
    list_contains(live, o.src) OR list_contains(live, o.dst) FROM scan s JOIN ord o ON o.k = s.k + 1
)""")
def j3s(t: DataFrame) -> DataFrame:
    e = t.withColumn("edge_seq", F.col("src") * 100 + F.col("dst")).select("edge_seq", "src", "dst")
    return paths.expanded(e.withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint")}), e.sparkSession.createDataFrame([(3,)], "node_id bigint"), "sequential")


@on_graph("j4_induced_subgraph", "SELECT src, dst FROM iedge")
def j4(g: Graph) -> DataFrame:
    return degree.induced(g.edges, attrs.with_attributes(g).select(F.col("owner").alias("node_id"))).select("src", "dst").distinct()


J5 = "SELECT DISTINCT d.src, t.release AS dst FROM dep d JOIN rng s ON d.src = s.release JOIN rng t ON t.artifact = d.artifact AND t.lo >= s.lo AND (s.hi IS NULL OR t.lo < s.hi)"


@on_graph("j5_interval_dependencies", J5)
def j5(g: Graph) -> DataFrame:
    return dependencies.release_graph(g)


@on_graph("j5_interval_cve_targets", J5 + " WHERE t.release IN (SELECT owner FROM strict)")
def j5c(g: Graph) -> DataFrame:
    return dependencies.release_graph(g, "cve")


J6 = "SELECT DISTINCT e.src AS artifact, d.artifact AS neighbor FROM edges e JOIN dep d ON e.dst = d.src WHERE e.label = 'relationship_AR' AND e.src <> d.artifact"


@on_graph("j6_two_hops", J6)
def j6(g: Graph) -> DataFrame:
    return dependencies.two_hops(g)


@on_graph("j6_two_hops_with_attributes", J6 + " AND e.src IN (SELECT owner FROM withattr) AND d.src IN (SELECT owner FROM withattr)")
def j6a(g: Graph) -> DataFrame:
    return dependencies.two_hops(g, attrs.with_attributes(g))


TOP_DEG = "tot AS (SELECT n.node_id, n.node_seq, n.id, count(e.v) AS degree FROM nodes n LEFT JOIN (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) e ON e.v = n.node_id GROUP BY ALL)"


@register("j7_named_top", f"WITH {O.GRAPH}, {TOP_DEG} SELECT node_id, id, degree, row_number() OVER (ORDER BY degree DESC, node_seq) AS rank FROM tot ORDER BY degree DESC, node_seq LIMIT 10", package_graph)
def j7(g: Graph) -> DataFrame:
    return degree.named(degree.top(degree.total(g), "degree"), g.nodes).select("node_id", "id", "degree", F.col("rank").cast("bigint").alias("rank"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy(F.col("c_nationkey").cast("string").alias("node")).agg(F.count("*").cast("double").alias("orders"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).cast("double").alias("done"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).cast("double").alias("urgent"))
    longf = per.select("node", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in ("orders", "done", "urgent")])).alias("m")).select("node", "m.*")
    return longf.withColumn("r", F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("score"), "node"))).where("r <= 10").drop("r")


SCORES = """WITH per AS (SELECT CAST(c_nationkey AS VARCHAR) AS node, count(*)::DOUBLE AS orders, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS done, (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
lng AS (SELECT node, 'orders' AS measure, orders AS score FROM per UNION ALL SELECT node, 'done', done FROM per UNION ALL SELECT node, 'urgent', urgent FROM per),
sc AS (SELECT * FROM lng QUALIFY row_number() OVER (PARTITION BY measure ORDER BY score DESC, node) <= 10),
z AS (SELECT node, measure, score, CASE WHEN stddev_pop(score) OVER m > 0 THEN (score - avg(score) OVER m) / stddev_pop(score) OVER m ELSE score - avg(score) OVER m END AS z FROM sc WINDOW m AS (PARTITION BY measure))
"""


@register("j8_aligned_scores", SCORES + "SELECT node, coalesce(max(score) FILTER (measure = 'orders'), 0) AS orders, coalesce(max(score) FILTER (measure = 'done'), 0) AS done, coalesce(max(score) FILTER (measure = 'urgent'), 0) AS urgent FROM sc GROUP BY node", _scores)
def j8(s: DataFrame) -> DataFrame:
    return stats.aligned(s, ["orders", "done", "urgent"])


@on_doc("j9_jaccard_pairs", "SELECT a, b, round(sim, 6) AS sim FROM sims", SIMS)
def j9(d: DataFrame) -> DataFrame:
    return similarity.pairs(similarity.cwe_packs(d)).select("a", "b", F.round("sim", 6).alias("sim"))


@register("j10_endpoint_weights", O.trade("SELECT t.src, t.dst, (coalesce(a.w, 1) * coalesce(b.w, 1))::DOUBLE AS weight FROM trade t LEFT JOIN w a ON a.k = t.src LEFT JOIN w b ON b.k = t.dst", "w AS (SELECT n_nationkey AS k, n_regionkey + 1 AS w FROM nation WHERE n_nationkey % 3 <> 0)"))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("node_id"), (F.col("n_regionkey") + 1).cast("double").alias("weight"))
    return centrality.weighted(trade_graph(spark, sf_dir), weights)


@on_graph("j11_severity_scores", "SELECT c.severity AS severity, CASE c.severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END::BIGINT AS score, count(*) AS n FROM ent GROUP BY ALL")
def j11(g: Graph) -> DataFrame:
    e = attrs.owned(g).select(F.explode(S.cve_list(F.col("value"))).alias("c"))
    return e.select("c.severity", S.severity_score(F.col("c.severity")).alias("score")).groupBy("severity", "score").agg(F.count("*").alias("n"))


ECO = [("a1", "One"), ("a2", "Two"), ("a3", "Three")]
ECO_SQL = "CASE WHEN contains(release, 'a1') THEN 'One' WHEN contains(release, 'a2') THEN 'Two' WHEN contains(release, 'a3') THEN 'Three' ELSE 'Maven' END"


@on_doc("j12_ecosystem", f"SELECT {ECO_SQL} AS eco, count(*) AS n FROM doc GROUP BY 1")
def j12(d: DataFrame) -> DataFrame:
    return d.select(similarity.ecosystem(F.col("release"), ECO).alias("eco")).groupBy("eco").agg(F.count("*").alias("n"))


PAIR = "coalesce({a}.e, 0)::INT AS {x}_cve_exists, coalesce({a}.s, 0) AS {x}_cve_score, coalesce({a}.c, 0) AS {x}_cve_num"
ONE_HOP = f"SELECT e.src AS source, e.dst AS target, {PAIR.format(a='p', x='source')}, {PAIR.format(a='q', x='target')}, coalesce(try_cast(n.timestamp AS BIGINT), 0) AS timestamp FROM edges e LEFT JOIN feat p ON p.owner = e.src LEFT JOIN feat q ON q.owner = e.dst LEFT JOIN nodes n ON n.node_id = e.dst"
TWO_HOP = f"SELECT h.artifact AS source, h.neighbor AS target, {PAIR.format(a='p', x='node')}, {PAIR.format(a='q', x='neighbor')}, coalesce(try_cast(n.timestamp AS BIGINT), 0) AS timestamp FROM ({J6} AND e.src IN (SELECT owner FROM withattr) AND d.src IN (SELECT owner FROM withattr)) h LEFT JOIN feat p ON p.owner = h.artifact LEFT JOIN feat q ON q.owner = h.neighbor LEFT JOIN nodes n ON n.node_id = h.neighbor"


@on_graph("m7_one_hop_pairs", ONE_HOP)
def m7(g: Graph) -> DataFrame:
    return causal.one_hop_pairs(g)


@on_graph("m8_two_hop_pairs", TWO_HOP)
def m8(g: Graph) -> DataFrame:
    return causal.two_hop_pairs(g)


# ---- aggregates


@register("a1_degree_total", f"WITH {O.GRAPH}, {TOP_DEG} SELECT node_id, degree FROM tot", package_graph)
def a1(g: Graph) -> DataFrame:
    return degree.total(g).select("node_id", "degree")


def _vulnerable(view: str) -> str:
    return f"SELECT n.node_id, count(e.dst) AS releases FROM nodes n LEFT JOIN edges e ON e.src = n.node_id AND e.label = 'relationship_AR' AND e.dst IN (SELECT owner FROM {view}) WHERE n.labels = ':Artifact' GROUP BY n.node_id"


@on_graph("a2_software_cve", _vulnerable("strict"))
def a2(g: Graph) -> DataFrame:
    return degree.vulnerable_releases(g).select("node_id", "releases")


@on_graph("a2_software_cve_any", _vulnerable("strict_any"))
def a2a(g: Graph) -> DataFrame:
    return degree.vulnerable_releases(g, "any").select("node_id", "releases")


@on_graph("a3_release_cve", "SELECT s.owner AS node_id, count(d.artifact) AS dependencies FROM strict s LEFT JOIN dep d ON d.src = s.owner GROUP BY s.owner")
def a3(g: Graph) -> DataFrame:
    return degree.dependencies_of_vulnerable(g).select("node_id", "dependencies")


@on_trade("a4_normalised_degree", "SELECT n_nationkey AS node_id, round(coalesce(d.c, 0) / 24.0::DOUBLE, 6) AS centrality FROM nation LEFT JOIN d ON d.v = n_nationkey", "d AS (SELECT v, count(*) AS c FROM (SELECT src AS v FROM trade UNION ALL SELECT dst FROM trade) GROUP BY v)")
def a4(t: DataFrame) -> DataFrame:
    nodes = t.sparkSession.range(25).select(F.col("id").cast("int").alias("node_id"))
    return degree.normalised(t, nodes).select("node_id", F.round("centrality", 6).alias("centrality"))


@on_graph("a5_in_out_degree", "SELECT node_id, outdegree, degree FROM fea")
def a5(g: Graph) -> DataFrame:
    v = attrs.with_attributes(g).select(F.col("owner").alias("node_id")).join(g.nodes.select("node_id"), "node_id", "left_semi")
    return degree.in_out(g.edges, v).select("node_id", F.col("outdegree").cast("bigint").alias("outdegree"), F.col("degree").cast("bigint").alias("degree"))


@on_graph("a6_severity", "SELECT owner, severity FROM sev")
def a6(g: Graph) -> DataFrame:
    return attrs.severity(g).select("owner", "severity")


@on_graph("a7_cve_features", "SELECT owner, e::INT AS exists, s AS score, c AS num FROM feat")
def a7(g: Graph) -> DataFrame:
    return causal.cve_features(g)


@on_graph("a8_value_counts", "SELECT type, count(*) AS n FROM nodes WHERE type IS NOT NULL GROUP BY type")
def a8(g: Graph) -> DataFrame:
    return g.nodes.where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


@on_graph("a9_unique", "SELECT count(DISTINCT value) + max((value IS NULL)::INT) AS n FROM nodes")
def a9(g: Graph) -> DataFrame:
    return g.nodes.agg((F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n"))


@on_doc("a10_most_common", "SELECT name, count(*) AS n FROM doc GROUP BY name ORDER BY n DESC, name LIMIT 6")
def a10(d: DataFrame) -> DataFrame:
    return d.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(6)


@on_doc("a11_ecosystem_stats", f"SELECT eco, count(*) AS releases, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, max(n) AS max, min(n) AS min FROM (SELECT {ECO_SQL} AS eco, count(*) AS n FROM doc GROUP BY release) GROUP BY eco")
def a11(d: DataFrame) -> DataFrame:
    return similarity.ecosystem_stats(d, ECO).withColumn("mean", F.round("mean", 6))


@on_doc("a12_cve_index", "SELECT name AS key, array_to_string(list_sort(list(release)), ' ') AS members FROM doc GROUP BY name")
def a12(d: DataFrame) -> DataFrame:
    return similarity.lists(similarity.cve_packs(d)).select("key", F.array_join("members", " ").alias("members"))


@on_doc("a13_cwe_counts", "SELECT cwe AS key, count(*) AS n FROM cwe GROUP BY cwe")
def a13(d: DataFrame) -> DataFrame:
    return similarity.counts(similarity.cwe_packs(d))


@on_doc("a13_cwe_cve_counts", "SELECT cwe AS key, count(DISTINCT name) AS n FROM cwe GROUP BY cwe")
def a13c(d: DataFrame) -> DataFrame:
    return similarity.counts(similarity.cwe_cves(d).distinct())


@on_doc("a14_packages", "SELECT regexp_replace(release, ':[^:]*$', '') AS package, count(*) AS n, count(DISTINCT name) AS names FROM doc GROUP BY 1")
def a14(d: DataFrame) -> DataFrame:
    return similarity.packages(d).groupBy(F.col("release").alias("package")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@on_doc("a15_ecosystem_groups", f"SELECT {ECO_SQL} AS eco, n, count(*) AS releases FROM (SELECT release, count(*) AS n FROM doc GROUP BY release) GROUP BY ALL")
def a15(d: DataFrame) -> DataFrame:
    per = d.groupBy("release").agg(F.count("*").alias("n"))
    return per.groupBy(similarity.ecosystem(F.col("release"), ECO).alias("eco"), "n").agg(F.count("*").alias("releases"))


@on_graph("a16_histories", "SELECT artifact, array_to_string(list(release ORDER BY lo, release), ' ') AS releases FROM rng GROUP BY artifact")
def a16(g: Graph) -> DataFrame:
    return dependencies.histories(g).select("artifact", F.array_join("releases", " ").alias("releases"))


@on_graph("a17_owners", "SELECT release, artifact FROM own")
def a17(g: Graph) -> DataFrame:
    return dependencies.owners(g)


@on_graph("a18_totals", "SELECT sum(popularity)::BIGINT AS popularity, sum(severity)::BIGINT AS severity, sum(popularity + severity + outdegree)::BIGINT AS everything FROM fea")
def a18(g: Graph) -> DataFrame:
    return stats.feature_matrix(g).agg(F.sum("popularity").alias("popularity"), F.sum("severity").alias("severity"), F.sum(F.col("popularity") + F.col("severity") + F.col("outdegree")).alias("everything"))


@on_graph("a19_min_max", "SELECT min(popularity) AS lo, max(popularity) AS hi FROM fea")
def a19(g: Graph) -> DataFrame:
    return stats.feature_matrix(g).agg(F.min("popularity").alias("lo"), F.max("popularity").alias("hi"))


@on_graph("a20_mean_std", "SELECT round(avg(severity), 6) AS mean, round(stddev_pop(severity), 6) AS std FROM fea")
def a20(g: Graph) -> DataFrame:
    return stats.feature_matrix(g).agg(F.round(F.avg("severity"), 6).alias("mean"), F.round(F.stddev_pop("severity"), 6).alias("std"))


COLS = ("freshness_missrelease", "freshness_outdays", "popularity", "speed", "severity", "outdegree")
CORR = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END, 5) AS corr FROM fea" for x in COLS for y in COLS)


@on_graph("a21_correlations", CORR)
def a21(g: Graph) -> DataFrame:
    return stats.correlations(stats.feature_matrix(g), list(COLS)).select("x", "y", F.round("corr", 5).alias("corr"))


PAIRCOLS = ["node_cve_exists", "node_cve_num", "neighbor_cve_exists", "neighbor_cve_num"]
#: All features of both ends, for the skeleton.
ALLCOLS = [f"{x}_cve_{c}" for x in ("node", "neighbor") for c in ("exists", "score", "num")]
#: Pairs of releases: the interval join's ends with their features.
REL_PAIRS = f"rp AS (SELECT {PAIR.format(a='p', x='node')}, {PAIR.format(a='q', x='neighbor')} FROM ({J5}) h LEFT JOIN feat p ON p.owner = h.src LEFT JOIN feat q ON q.owner = h.dst)"


def _release_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = package_graph(spark, sf_dir)
    return causal._both_ends(g, dependencies.release_graph(g).select(F.col("src").alias("source"), F.col("dst").alias("target")), "node", "neighbor")


@register("a22_contingency", f"WITH {O.GRAPH}, {REL_PAIRS} SELECT {', '.join(PAIRCOLS)}, count(*) AS n FROM rp GROUP BY ALL", _release_pairs)
def a22(p: DataFrame) -> DataFrame:
    return causal.histogram(p, PAIRCOLS)


@on_graph("a23_nonblank_share", "SELECT round(100.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 6) AS percent FROM cvx WHERE type = 'CVE'")
def a23(g: Graph) -> DataFrame:
    x = g.nodes.where("type = 'CVE'").select(F.size(S.cve_list(F.col("value"))).alias("n"))
    return x.agg(F.round(100.0 * F.count(F.when(F.col("n") > 0, 1)) / F.count("*"), 6).alias("percent"))


# ---- windows, order, sets


@on_graph("w1_validity_ranges", "SELECT release, artifact, lo, hi FROM rng")
def w1(g: Graph) -> DataFrame:
    return dependencies.ranges(g)


@on_graph("w2_first_attribute", "SELECT owner, type, value FROM fst")
def w2(g: Graph) -> DataFrame:
    return attrs.first(attrs.owned(g))


RANKED = "WITH {d} SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS rank FROM doc GROUP BY name ORDER BY n DESC, name LIMIT {k} {o}"


@register("w3_ranked", RANKED.format(d=O.DOC, k=100, o=""), cve_entries)
def w3(d: DataFrame) -> DataFrame:
    top = d.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(100)
    return top.select("name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("bigint").alias("rank"))


@on_graph("w4_last_write", "SELECT owner, max_by(value, edge_seq) AS value FROM att GROUP BY owner")
def w4(g: Graph) -> DataFrame:
    return attrs.owned(g).groupBy("owner").agg(F.max_by("value", "edge_seq").alias("value"))


@on_doc("w5_skip_most_common", "SELECT name, count(*) AS n FROM doc GROUP BY name ORDER BY n DESC, name LIMIT 20 OFFSET 1")
def w5(d: DataFrame) -> DataFrame:
    return d.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").offset(1).limit(20)


@register("t1_top_degree", f"WITH {O.GRAPH}, {TOP_DEG} SELECT node_id, degree FROM tot ORDER BY degree DESC, node_seq LIMIT 10", package_graph)
def t1(g: Graph) -> DataFrame:
    return degree.total(g).orderBy(F.desc("degree"), "node_seq").limit(10).select("node_id", "degree")


@on_doc("t4_ascending", "SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*), name) AS place FROM doc GROUP BY name ORDER BY n, name LIMIT 50")
def t4(d: DataFrame) -> DataFrame:
    return similarity.ascending(d.groupBy("name").agg(F.count("*").alias("n")), "n", "name", 50)


@on_doc("t6_sorted_names", "SELECT release, array_to_string(list_sort(list(DISTINCT name)), ' ') AS names FROM doc GROUP BY release")
def t6(d: DataFrame) -> DataFrame:
    return similarity.lists(d.select(F.col("release").alias("key"), F.col("name").alias("member")).distinct()).select(F.col("key").alias("release"), F.array_join("members", " ").alias("names"))


@on_graph("t7_release_order", "SELECT artifact, release, row_number() OVER (PARTITION BY artifact ORDER BY lo, node_seq) AS place FROM rng JOIN nodes ON node_id = release")
def t7(g: Graph) -> DataFrame:
    x = dependencies.ranges(g).join(g.nodes.select("node_id", "node_seq"), F.col("release") == F.col("node_id"))
    return x.select("artifact", "release", F.row_number().over(Window.partitionBy("artifact").orderBy("lo", "node_seq")).cast("bigint").alias("place"))


@on_graph("u1_graph_union", "SELECT DISTINCT src, dst FROM edges WHERE label IN ('dependency', 'relationship_AR')")
def u1(g: Graph) -> DataFrame:
    return g.label(NEEDS).select("src", "dst").unionByName(g.label(OWNS).select("src", "dst")).distinct()


@on_doc("u2_set_sizes", "SELECT a, b, c AS both, p.n + q.n - c AS either FROM bo JOIN sz p ON a = p.key JOIN sz q ON b = q.key", SIMS)
def u2(d: DataFrame) -> DataFrame:
    return similarity.set_sizes(similarity.cwe_packs(d)).select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


@on_graph("u3_key_union", "SELECT src AS node FROM edges WHERE label = 'dependency' UNION SELECT dst FROM edges WHERE label = 'dependency'")
def u3(g: Graph) -> DataFrame:
    e = g.label(NEEDS)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@on_graph("u4_list_extend", "SELECT label, count(*) AS n FROM (SELECT label FROM edges UNION ALL SELECT label FROM edges WHERE label = 'dependency') GROUP BY label")
def u4(g: Graph) -> DataFrame:
    return g.edges.select("label").unionAll(g.label(NEEDS).select("label")).groupBy("label").agg(F.count("*").alias("n"))


# ---- scalar functions


@register("f1_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.whole(F.from_json(S.unescaped(F.col("props")), "k string")["k"]).alias("k"))


@on_graph("f2_cve_names", "SELECT c.name AS name, c.cwe AS cwe, count(*) AS n FROM ent GROUP BY ALL")
def f2(g: Graph) -> DataFrame:
    return attrs.owned(g).select(F.explode(S.cve_list(F.col("value"))).alias("c")).groupBy("c.name", "c.cwe").agg(F.count("*").alias("n"))


@on_graph("f3_numbers", "SELECT owner, round(try_cast(value AS DOUBLE), 6) AS real FROM att WHERE type = 'SPEED'")
def f3(g: Graph) -> DataFrame:
    return attrs.owned(g).where("type = 'SPEED'").select("owner", F.round(S.real(F.col("value")), 6).alias("real"))


@on_graph("f4_timestamps", "SELECT node_id, coalesce(try_cast(timestamp AS BIGINT), 0) AS ts FROM nodes")
def f4(g: Graph) -> DataFrame:
    return g.nodes.select("node_id", S.when_ms(F.col("timestamp")).alias("ts"))


@on_graph("f5_days", "SELECT owner, round(ms / 86400000.0::DOUBLE, 6) AS days FROM qty WHERE ms IS NOT NULL")
def f5(g: Graph) -> DataFrame:
    return attrs.owned(g).where("type = 'FRESHNESS'").select("owner", F.round(S.days(S.whole(S.freshness(F.col("value"))["outdatedTimeInMs"])), 6).alias("days"))


@on_doc("f6_cwe_ids", "SELECT DISTINCT cwe_ids, array_to_string(regexp_extract_all(cwe_ids, 'CWE-[0-9]+'), ' ') AS ids FROM doc")
def f6(d: DataFrame) -> DataFrame:
    return d.select("cwe_ids", F.array_join(S.cwe_ids(F.col("cwe_ids")), " ").alias("ids")).distinct()


@on_doc("f8_name_parts", "SELECT DISTINCT release, array_to_string(string_split(release, ':')[-2:], ':') AS last, regexp_replace(release, ':[^:]*$', '') AS head FROM doc")
def f8(d: DataFrame) -> DataFrame:
    r = F.col("release")
    return d.select("release", S.last_tokens(r).alias("last"), S.without_last(r).alias("head")).distinct()


@on_doc("f9_stacked", "SELECT DISTINCT replace(release, ':', chr(10)) AS label FROM doc")
def f9(d: DataFrame) -> DataFrame:
    return d.select(S.stacked(F.col("release")).alias("label")).distinct()


@on_doc("f10_split_at_dots", "SELECT DISTINCT regexp_replace(replace(release, ':', '.'), '\\.([^.]*)\\.([^.]*)$', chr(10) || '\\1' || chr(10) || '\\2') AS label FROM doc")
def f10(d: DataFrame) -> DataFrame:
    return d.select(S.split_at_dots(F.replace("release", F.lit(":"), F.lit("."))).alias("label")).distinct()


@register("f11_min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS x FROM customer")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    s = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.crossJoin(F.broadcast(s)).select("c_custkey", F.round(S.min_max(F.col("c_acctbal"), F.col("lo"), F.col("hi")), 6).alias("x"))


@register("f13_standardised", SCORES + "SELECT measure, node, round(z, 6) AS z FROM z", _scores)
def f13(s: DataFrame) -> DataFrame:
    return stats.standardised(s).select("measure", "node", F.round("z", 6).alias("z"))


@register("f18_scaled", SCORES + "SELECT measure, node, score * CASE measure WHEN 'orders' THEN 1000 WHEN 'done' THEN 10000 ELSE 10000000 END AS scaled FROM sc", _scores)
def f18(s: DataFrame) -> DataFrame:
    return s.select("measure", "node", (F.col("score") * F.when(F.col("measure") == "orders", 1000.0).when(F.col("measure") == "done", 10000.0).otherwise(10000000.0)).alias("scaled"))


# ---- graph algorithms


#: Distances and numbers of shortest paths between all nodes of a small graph.
COUNTED = """far AS (SELECT src AS s, dst AS t, 1 AS d FROM trade UNION SELECT f.s, e.dst, f.d + 1 FROM far f JOIN trade e ON e.src = f.t WHERE f.s <> e.dst AND f.d < 24),
dist AS (SELECT s, t, min(d) AS d FROM far GROUP BY s, t),
ways AS (
  SELECT src AS s, dst AS t, 1 AS d, 1::DOUBLE AS c FROM trade
  UNION ALL
  SELECT w.s, e.dst, w.d + 1, sum(w.c) FROM ways w JOIN trade e ON e.src = w.t JOIN dist x ON x.s = w.s AND x.t = e.dst AND x.d = w.d + 1 GROUP BY w.s, e.dst, w.d
)"""


@on_trade("g1_betweenness", "SELECT n_nationkey AS node_id, round(coalesce(b, 0) / (23 * 24), 6) AS centrality FROM nation LEFT JOIN (SELECT p.t AS v, sum(p.c * q.c / w.c) AS b FROM ways p JOIN ways q ON q.s = p.t JOIN ways w ON w.s = p.s AND w.t = q.t AND w.d = p.d + q.d GROUP BY p.t) ON v = n_nationkey", COUNTED)
def g1(t: DataFrame) -> DataFrame:
    nodes = t.sparkSession.range(25).select(F.col("id").cast("int").alias("node_id"))
    return centrality.betweenness(t, nodes).select("node_id", F.round("centrality", 6).alias("centrality"))


BFS = """bfs AS (
  SELECT 3 AS node, 0 AS distance, [3] AS path
  UNION ALL
  SELECT t.dst, b.distance + 1, list_append(b.path, t.dst) FROM bfs b JOIN trade t ON t.src = b.node WHERE NOT list_contains(b.path, t.dst) AND b.distance < 4
)"""


@on_trade("g2_shortest_paths", "SELECT node, distance::INT AS distance, array_to_string(path, ' ') AS path FROM bfs QUALIFY distance = min(distance) OVER (PARTITION BY node)", BFS)
def g2(t: DataFrame) -> DataFrame:
    return paths.shortest_paths(t, 3).select("node", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@on_trade("g3_eigenvector", "SELECT node AS node_id, round(x, 4) AS centrality FROM it WHERE k = 400", """ent AS (SELECT src, dst, cents / 1e9 AS w FROM trade UNION ALL SELECT n_nationkey, n_nationkey, 1.0 FROM nation),
it AS (
  SELECT 0 AS k, n_nationkey AS node, 0.2::DOUBLE AS x FROM nation
  UNION ALL
  SELECT k + 1, node, y / sqrt(sum(y * y) OVER ()) FROM (SELECT it.k, e.dst AS node, sum(e.w * it.x) AS y FROM it JOIN ent e ON e.src = it.node WHERE it.k < 400 GROUP BY it.k, e.dst)
)""")
def g3(t: DataFrame) -> DataFrame:
    nodes = t.sparkSession.range(25).select(F.col("id").cast("int").alias("node_id"))
    return centrality.eigenvector(t.select("src", "dst", (F.col("cents") / 1e9).alias("weight")), nodes, tol=1e-10).select("node_id", F.round("centrality", 4).alias("centrality"))


@on_graph("g4_release_graph_sizes", f"SELECT count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ({J5})")
def g4(g: Graph) -> DataFrame:
    return dependencies.release_graph(g).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@on_trade("g6_distances", "SELECT s AS src, t AS dst, d::INT AS distance FROM dist", COUNTED.split("ways AS")[0].rstrip(",\n"))
def g6(t: DataFrame) -> DataFrame:
    return paths.distances(t)


#: The trade between regions, which has so few nodes that all simple paths can be listed.
ALL_PATHS = """rp AS (SELECT a.n_regionkey AS src, b.n_regionkey AS dst, sum(cents) AS cents FROM pr JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst GROUP BY ALL),
sm AS (SELECT src, dst FROM rp WHERE cents > (SELECT sum(cents) / count(*) FROM rp) AND src <> dst), sp AS (
  SELECT [src, dst] AS path FROM sm
  UNION ALL
  SELECT list_append(p.path, s.dst) FROM sp p JOIN sm s ON s.src = p.path[-1] WHERE NOT list_contains(p.path, s.dst)
)"""


@register("g7_simple_paths", O.trade("SELECT array_to_string(path, ' ') AS path FROM sp", ALL_PATHS), region_graph)
def g7(t: DataFrame) -> DataFrame:
    return paths.simple_paths(t).select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@register("p9_busy_paths", O.trade("SELECT array_to_string(path, ' ') AS path, len(list_intersect(path[2:-2], l)) AS marked FROM sp, (SELECT list(k) AS l FROM (SELECT n_regionkey AS k FROM nation GROUP BY k HAVING count(*) >= 5)) WHERE marked >= 1", ALL_PATHS))
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("owner")).agg(F.count("*").alias("n")).where("n >= 5")
    found = paths.busy_paths(paths.simple_paths(region_graph(spark, sf_dir)), marked, 1)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.col("marked").cast("bigint").alias("marked"))


@on_trade("g8_simple_digraph", "SELECT DISTINCT src, dst FROM trade")
def g8(t: DataFrame) -> DataFrame:
    return t.select("src", "dst").union(t.select("src", "dst")).distinct()


# ---- statistics


@on_graph("m1_quantities", "SELECT n.node_id, coalesce(popularity, 0) AS popularity, coalesce(missed, 0) AS missed, round(coalesce(ms, 0) / 86400000.0::DOUBLE, 6) AS outdated_days, round(coalesce(speed, 0), 6) AS speed FROM nodes n LEFT JOIN qty ON owner = node_id")
def m1(g: Graph) -> DataFrame:
    return attrs.quantities(g).select("node_id", "popularity", "missed", F.round("outdated_days", 6).alias("outdated_days"), F.round("speed", 6).alias("speed"))


@on_graph("m2_feature_matrix", "SELECT node_id, freshness_missrelease, round(freshness_outdays, 6) AS freshness_outdays, popularity, round(speed, 6) AS speed, severity, outdegree, degree FROM fea")
def m2(g: Graph) -> DataFrame:
    x = stats.feature_matrix(g)
    return x.withColumns({"freshness_outdays": F.round("freshness_outdays", 6), "speed": F.round("speed", 6), "outdegree": F.col("outdegree").cast("bigint"), "degree": F.col("degree").cast("bigint")})


@on_graph("m4_stepwise")
def m4(g: Graph) -> DataFrame:
    chosen = stats.stepwise(stats.feature_matrix(g))
    return g.nodes.sparkSession.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "round int, feature string")


FEATS = COLS[:5]
W_SQL = "one AS (SELECT " + ", ".join(f"coalesce(abs(CASE WHEN isnan(corr({f}, outdegree)) THEN NULL ELSE corr({f}, outdegree) END), 0) AS c{i}" for i, f in enumerate(FEATS)) + " FROM fea), " + "raw AS (SELECT node_id, " + " + ".join(f"{f} * CASE WHEN c0 + c1 + c2 + c3 + c4 > 0 THEN c{i} / (c0 + c1 + c2 + c3 + c4) ELSE 0.2 END" for i, f in enumerate(FEATS)) + " AS r FROM fea, one)"


@register("m5_average_weight", f"WITH {O.GRAPH}, {W_SQL} SELECT node_id, round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 5) AS weight FROM raw", package_graph)
def m5(g: Graph) -> DataFrame:
    return stats.average_weight(stats.feature_matrix(g), factor=1.0).select("node_id", F.round("weight", 5).alias("weight"))


@register("m6_correlated_weight", f"WITH {O.GRAPH}, one AS (SELECT " + ", ".join(f"coalesce(CASE WHEN isnan(corr({f}, outdegree)) THEN NULL ELSE corr({f}, outdegree) END, 0) AS c{i}" for i, f in enumerate(FEATS)) + " FROM fea) SELECT node_id, round(" + " + ".join(f"{f} * c{i}" for i, f in enumerate(FEATS)) + ", 4) AS weight FROM fea, one", package_graph)
def m6(g: Graph) -> DataFrame:
    return stats.correlated_weight(stats.feature_matrix(g)).select("node_id", F.round("weight", 4).alias("weight"))


@register("m9_skeleton", None, _release_pairs)
def m9(p: DataFrame) -> DataFrame:
    return p.sparkSession.createDataFrame(causal.skeleton(p, ALLCOLS), "src string, dst string")


BIC_EDGES = [("node_cve_exists", "node_cve_num"), ("node_cve_num", "neighbor_cve_num")]


def _bic_sql(v: str, pa: list[str]) -> str:
    by = ", ".join(pa)
    base = f"sum(n) OVER (PARTITION BY {by})" if pa else "sum(n) OVER ()"
    q = " * ".join(f"(SELECT count(DISTINCT {p}) FROM rp)" for p in pa) or "1"
    return f"SELECT '{v}' AS node, round((SELECT sum(n * ln(n / m)) FROM (SELECT n::DOUBLE AS n, {base} AS m FROM (SELECT {', '.join([*pa, v])}, count(*) AS n FROM rp GROUP BY ALL))) - ln((SELECT count(*) FROM rp)) / 2 * {q} * ((SELECT count(DISTINCT {v}) FROM rp) - 1), 3) AS score"


@register("m10_bic", f"WITH {O.GRAPH}, {REL_PAIRS} " + " UNION ALL ".join(_bic_sql(v, [x for x, y in BIC_EDGES if y == v]) for v in ("node_cve_exists", "node_cve_num", "neighbor_cve_num")), _release_pairs)
def m10(p: DataFrame) -> DataFrame:
    return causal.bic(p, BIC_EDGES).select("node", F.round("score", 3).alias("score"))


@register("m11_discover", None, _release_pairs)
def m11(p: DataFrame) -> DataFrame:
    edges, score = causal.discover(p, ALLCOLS)
    return p.sparkSession.createDataFrame([(len(edges), round(score, 3))], "edges int, bic double")


@register("m12_path_effect", f"WITH {O.GRAPH}, {REL_PAIRS}, s AS (SELECT count(*) AS n, regr_slope(neighbor_cve_score, node_cve_score) AS b, var_pop(node_cve_score) AS vx, var_pop(neighbor_cve_score) AS vy, covar_pop(neighbor_cve_score, node_cve_score) AS c FROM rp), r AS (SELECT *, vy - c * c / vx AS residual FROM s) SELECT round(b, 6) AS estimate, round(sqrt(residual / (n * vx)), 6) AS std_err, round(b / sqrt(residual / (n * vx)), 4) AS z, round(residual, 6) AS residual FROM r", _release_pairs)
def m12(p: DataFrame) -> DataFrame:
    return causal.path_effect(p).select(F.round("estimate", 6).alias("estimate"), F.round("std_err", 6).alias("std_err"), F.round("z", 4).alias("z"), F.round("residual", 6).alias("residual"))


@on_doc("m13_share_similar", "SELECT count(*) FILTER (sim > 0.1) AS above, (SELECT count(*) * (count(*) - 1) // 2 FROM sz) AS total FROM sims", SIMS)
def m13(d: DataFrame) -> DataFrame:
    return similarity.thresholds(similarity.cwe_packs(d), [0.1]).select("above", "total")


@on_doc("m14_thresholds", "SELECT t / 10.0::DOUBLE AS threshold, (SELECT count(*) FROM sims WHERE sim > t / 10.0::DOUBLE) AS above, (SELECT count(*) * (count(*) - 1) // 2 FROM sz) AS total FROM range(1, 10) r(t)", SIMS)
def m14(d: DataFrame) -> DataFrame:
    return similarity.thresholds(similarity.cwe_packs(d)).select("threshold", "above", "total")


@on_graph("m15_freshness_score", "SELECT DISTINCT value, round(0.5 * (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) + 0.5 * (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()), 6) AS score FROM (SELECT value, json_extract_string(replace(value, '\\\"', '\"'), '$.freshness.numberMissedRelease')::BIGINT::DOUBLE AS m, json_extract_string(replace(value, '\\\"', '\"'), '$.freshness.outdatedTimeInMs')::BIGINT::DOUBLE AS t FROM nodes WHERE type = 'FRESHNESS')")
def m15(g: Graph) -> DataFrame:
    return stats.freshness_score(g.nodes.where("type = 'FRESHNESS'")).select("value", F.round("score", 6).alias("score")).distinct()


@register("m16_combined_score", SCORES + "SELECT node, round(sum(z), 6) AS total FROM z GROUP BY node ORDER BY sum(z) DESC, node LIMIT 10", _scores)
def m16(s: DataFrame) -> DataFrame:
    return stats.combined(s, ["orders", "done", "urgent"]).select("node", F.round("total", 6).alias("total"))


# ---- whole drivers


@on_graph("d_dependency_driver", J5 + " WHERE t.release IN (SELECT owner FROM strict)")
def d2(g: Graph) -> DataFrame:
    return drivers.dependency_graph(g)


def _similar(index: str, keys: str) -> str:
    return f"""SELECT '{index}' AS index, t / 10.0::DOUBLE AS threshold, (SELECT count(*) FROM ({SIMILAR.format(keys=keys)}) WHERE sim > t / 10.0::DOUBLE) AS above,
  (SELECT count(DISTINCT key) * (count(DISTINCT key) - 1) // 2 FROM ({keys})) AS total FROM range(1, 10) r(t)"""


SIMILAR = "WITH ks AS ({keys}), sz AS (SELECT key, count(*) AS n FROM ks GROUP BY key) SELECT c::DOUBLE / (p.n + q.n - c) AS sim FROM (SELECT x.key AS a, y.key AS b, count(*) AS c FROM ks x JOIN ks y USING (member) WHERE x.key < y.key GROUP BY ALL) JOIN sz p ON a = p.key JOIN sz q ON b = q.key"
INDEXES = {"cve-pack": "SELECT DISTINCT name AS key, release AS member FROM doc", "cwe-pack": "SELECT DISTINCT cwe AS key, release AS member FROM cwe", "cwe-cve": "SELECT DISTINCT cwe AS key, name AS member FROM cwe"}


@on_doc("d_similarity_driver", " UNION ALL ".join(_similar(k, v) for k, v in INDEXES.items()))
def d3(d: DataFrame) -> DataFrame:
    return drivers.similarity_report(d)


def _top(view: str, score: str, name: str) -> str:
    return f"(SELECT '{name}' AS report, row_number() OVER (ORDER BY {score} DESC, node_seq)::INT AS rank, n.node_id, {score} AS score FROM ({view}) v JOIN nodes n ON n.node_id = v.node_id ORDER BY {score} DESC, node_seq LIMIT 10)"


DEGREE_SQL = f"WITH {O.GRAPH}, {TOP_DEG} " + " UNION ALL ".join([
    "(SELECT 'degree' AS report, row_number() OVER (ORDER BY degree DESC, node_seq)::INT AS rank, node_id, degree AS score FROM tot ORDER BY degree DESC, node_seq LIMIT 10)",
    _top(_vulnerable("strict"), "releases", "vulnerable_releases"),
    _top("SELECT s.owner AS node_id, count(d.artifact) AS dependencies FROM strict s LEFT JOIN dep d ON d.src = s.owner GROUP BY s.owner", "dependencies", "dependencies"),
])


@register("d_degree_driver", DEGREE_SQL, package_graph)
def d4(g: Graph) -> DataFrame:
    out = None
    for name, top in drivers.degree_reports(g).items():
        score = {"degree": "degree", "vulnerable_releases": "releases", "dependencies": "dependencies"}[name]
        one = top.select(F.lit(name).alias("report"), F.col("rank").cast("int").alias("rank"), "node_id", F.col(score).cast("bigint").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@on_graph("d_betweenness_driver")
def d6(g: Graph) -> DataFrame:
    return drivers.betweenness_report(g).select("rank", "node_id", F.round("centrality", 8).alias("centrality"))


@on_graph("d_causal_driver")
def d7(g: Graph) -> DataFrame:
    """The skeleton's edges with its score, its number of simple paths and the longest of its shortest paths."""
    found = drivers.causal_report(g)
    rows = [(x, y, round(found["bic"], 3), found["paths"].count(), found["longest"]) for x, y in found["edges"]]
    return g.nodes.sparkSession.createDataFrame(rows, "src string, dst string, bic double, paths long, longest int")
