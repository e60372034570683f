import math
import random

import pytest
from pyspark.sql import functions as F

from depsight.operators import attrs, causal, centrality, degree, dependencies, paths, stats
from depsight.plans import drivers
from depsight.sources import graph as io

from .graphs import graph, pairs


def test_degrees(spark):
    g = graph(spark)
    total = dict(pairs(degree.total(g), "node_id", "degree"))
    assert total == {"a1": 5, "a3": 4, "r3": 4, "r4": 4, "a2": 3, "r1": 3, "r2": 3, "r5": 3, **{f"v{k}": 1 for k in range(1, 8)}}
    assert sum(total.values()) == 2 * g.edges.count()
    assert pairs(degree.vulnerable_releases(g), "node_id", "releases") == {("a1", 1), ("a2", 1), ("a3", 0)}
    assert pairs(degree.vulnerable_releases(g, "any"), "node_id", "releases") == {("a1", 1), ("a2", 2), ("a3", 0)}
    assert pairs(degree.dependencies_of_vulnerable(g), "node_id", "dependencies") == {("r4", 2), ("r1", 1)}
    top = degree.named(degree.top(degree.total(g), "degree", 3), g.nodes)
    assert pairs(top, "id", "rank") == {("g:a1", 1), ("g:a3", 2), ("g:a2:r3", 3)}


def test_attribute_checks(spark):
    g = graph(spark)
    assert pairs(attrs.having(g), "owner") == {("r1",), ("r4",)}
    assert pairs(attrs.having(g, scope="any"), "owner") == {("r1",), ("r3",), ("r4",)}
    assert pairs(attrs.having(g, strict=False), "owner") == {("r1",), ("r2",), ("r4",)}
    assert pairs(attrs.having(g, "POPULARITY_1_YEAR"), "owner") == set()
    assert pairs(attrs.severity(g), "owner", "severity", "cves") == {("r1", 4, 2), ("r2", 0, 0), ("r4", 2, 2)}
    r3 = attrs.quantities(g).where("node_id = 'r3'").first()
    assert r3["missed"] == 7 and math.isclose(r3["outdated_days"], 43.93246527777778)


def test_ranges_and_joins(spark):
    g = graph(spark)
    assert pairs(dependencies.ranges(g), "release", "lo", "hi") == {("r1", 100, 200), ("r2", 200, None), ("r3", 150, 250), ("r4", 250, None), ("r5", 120, None)}
    assert pairs(dependencies.release_graph(g), "src", "dst") == {("r1", "r5"), ("r3", "r2"), ("r5", "r3"), ("r5", "r4")}
    assert pairs(dependencies.release_graph(g, "cve"), "src", "dst") == {("r5", "r4")}
    assert pairs(dependencies.two_hops(g), "artifact", "neighbor") == {("a1", "a3"), ("a2", "a1"), ("a2", "a3"), ("a3", "a2")}
    plan = dependencies.release_graph(g)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_times_give_an_empty_range(spark):
    g = graph(spark)
    same = g.nodes.withColumn("timestamp", F.when(F.col("node_id").isin("r1", "r2"), "100").otherwise(F.col("timestamp")))
    r = {x["release"]: (x["lo"], x["hi"]) for x in dependencies.ranges(type(g)(same, g.edges)).collect()}
    assert r["r1"] == (100, 100)


def test_graphml_round_trip(spark, tmp_path):
    g = graph(spark)
    io.write_graphml(g, str(tmp_path / "g"))
    back = io.read_graphml(spark, str(tmp_path / "g" / "*"))
    fields = ("node_id", "labels", "id", "timestamp", "type", "value")
    assert pairs(back.nodes, *fields) == pairs(g.nodes, *fields)
    assert pairs(back.edges, "src", "dst", "label") == pairs(g.edges, "src", "dst", "label")


def test_graphml_with_namespace_and_repeated_keys(spark, tmp_path):
    p = tmp_path / "x.graphml"
    p.write_text('<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph id="G" edgedefault="directed"><node id="n1"><data key="labels">:Release</data><data key="id">x</data><data key="id">y</data></node><node id="n2"></node><edge id="e0" source="n1" target="n2" label="dependency"><data key="label">dependency</data></edge></graph></graphml>')
    g = io.read_graphml(spark, str(p))
    assert pairs(g.nodes, "node_id", "id") == {("n1", "y"), ("n2", None)}
    assert pairs(g.edges, "src", "dst", "label") == {("n1", "n2", "dependency")}


def test_json_document_and_cache(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('{"g:core:1.0": [{"name": "CVE-1", "cwe_ids": "[CWE-20,CWE-79]"}],\n "g:util:1.0": [{"name": "UNKNOWN", "cwe_ids": "UNKNOWN"}]}')
    assert pairs(io.read_cve_document(spark, str(p)), "release", "name") == {("g:core:1.0", "CVE-1"), ("g:util:1.0", "UNKNOWN")}
    made = []
    for _ in range(2):
        assert io.materialized(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]


def test_sequential_expansion_equals_one_pass(spark):
    r = random.Random(4)
    for _ in range(3):
        edges = [(k, r.randrange(12), r.randrange(12)) for k in range(25)]
        grown, kept = {0}, set()
        for k, u, v in edges:
            if u in grown or v in grown:
                grown |= {u, v}
                kept.add((k, u, v))
        got = paths.expanded(spark.createDataFrame(edges, "edge_seq long, src long, dst long"), spark.createDataFrame([(0,)], "node_id long"), "sequential")
        assert pairs(got, "edge_seq", "src", "dst") == kept


def test_paths(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    assert {"".join(p) for (p,) in ((r["path"],) for r in paths.simple_paths(e).collect())} == {"xy", "yz", "xz", "xyz"}
    assert paths.chain_length(e) == 1
    assert paths.chain_length(e.limit(0)) is None
    d = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")], "src string, dst string")
    got = {(r["node"], r["distance"], "".join(r["path"])) for r in paths.shortest_paths(d, "s").collect()}
    assert got == {("s", 0, "s"), ("a", 1, "sa"), ("b", 1, "sb"), ("t", 2, "sat"), ("t", 2, "sbt")}


def test_betweenness(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "z")], "src string, dst string")
    nodes = spark.createDataFrame([("x",), ("y",), ("z",)], "node_id string")
    assert dict(pairs(centrality.betweenness(e, nodes), "node_id", "centrality")) == {"x": 0.0, "y": 0.5, "z": 0.0}


def test_eigenvector(spark):
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (1, 3, 2.0)], "src int, dst int, weight double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id int")
    got = dict(pairs(centrality.eigenvector(ring, nodes, tol=1e-6), "node_id", "centrality"))
    assert all(math.isclose(got[k], v, abs_tol=1e-4) for k, v in {1: 0.5, 2: 0.309017, 3: 0.809017}.items())
    assert math.isclose(sum(v * v for v in got.values()), 1, abs_tol=1e-9)
    with pytest.raises(ValueError):
        centrality.eigenvector(ring, nodes, rounds=2, tol=1e-12)
    with pytest.raises(ValueError):
        centrality.eigenvector(ring, nodes.limit(0))


def test_bic_and_skeleton(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "x int, y int")
    assert math.isclose(causal.bic(d, [("x", "y")]).agg(F.sum("score")).first()[0], -6.238324625039508)
    assert causal.bic(d, []).count() == 0
    r = random.Random(2)
    rows = []
    for _ in range(1500):
        a = r.randrange(2)
        b = a if r.random() < 0.85 else 1 - a
        c = b if r.random() < 0.85 else 1 - b
        rows.append((a, b, c, r.randrange(2)))
    edges = causal.skeleton(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"], level=0.001)
    assert edges == [("a", "b"), ("b", "c")]


def test_tails():
    assert math.isclose(causal.chi_square_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(causal.chi_square_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert causal.chi_square_tail(5, 0) == 1.0
    assert math.isclose(stats.t_tail(2.2281388519649385, 10), 0.05, rel_tol=1e-8)


def test_stepwise_and_weights(spark):
    r = random.Random(1)
    rows = []
    for _ in range(200):
        a, b = r.random(), r.random()
        rows.append((a, b, 1.0, 3 * a + b + r.random() * 0.1))
    d = spark.createDataFrame(rows, "a double, b double, c double, outdegree double")
    assert stats.stepwise(d, features=["a", "b", "c"]) == ["a", "b"]
    w = stats.average_weight(d, ["a", "b", "c"], factor=10.0).agg(F.min("weight"), F.max("weight")).first()
    assert math.isclose(w[0], 0) and math.isclose(w[1], 10)
    assert stats.correlated_weight(d, ["a", "c"], target=None).where("weight is not null").count() == 0


def test_standardised_constant_is_centred(spark):
    d = spark.createDataFrame([("m", k, 4.0) for k in range(3)], "measure string, node int, score double")
    assert {r["z"] for r in stats.standardised(d).collect()} == {0.0}


def test_pair_tables_and_effect(spark):
    g = graph(spark)
    assert causal.one_hop_pairs(g).count() == 18
    assert pairs(causal.two_hop_pairs(g), "source", "target") == {("a1", "a3")}
    d = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "node_cve_score double, neighbor_cve_score double")
    assert math.isclose(causal.path_effect(d).first()["estimate"], 2.0)


def test_drivers(spark):
    g = graph(spark)
    with pytest.raises(ValueError):
        drivers.centrality_report(g, 3, rounds=5)
    assert drivers.betweenness_report(g, 3).count() == 3
    assert drivers.degree_reports(g)["degree"].count() == 10
    got = drivers.causal_report(g, ["node_cve_exists", "neighbor_cve_exists"])
    assert got["edges"] == [] and got["bic"] == 0.0 and got["longest"] is None


def test_numbered_is_gapless(spark):
    got = [r["n"] for r in io.numbered(spark.range(500).repartition(5), "n", "id").orderBy("id").collect()]
    assert got == list(range(500))
