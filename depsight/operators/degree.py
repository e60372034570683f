"""Degree counts and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ARTIFACT, NEEDS, OWNS, RELEASE, Graph
from .attrs import having


def _filled(nodes: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    return nodes.select("node_id", "node_seq").join(counts, "node_id", "left").select("node_id", "node_seq", F.coalesce(name, F.lit(0)).alias(name))


def total(g: Graph) -> DataFrame:
    """node_id, node_seq, degree: in and out, parallel edges counted, a loop twice, zero kept."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return _filled(g.nodes, ends.groupBy("node_id").agg(F.count("*").alias("degree")), "degree")


def vulnerable_releases(g: Graph, scope: str = "first") -> DataFrame:
    """Per artifact: edges to strictly vulnerable releases."""
    hit = g.label(OWNS).join(having(g, scope=scope), F.col("dst") == F.col("owner"), "left_semi")
    return _filled(g.kind(ARTIFACT), hit.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("releases")), "releases")


def dependencies_of_vulnerable(g: Graph, scope: str = "first") -> DataFrame:
    """Per strictly vulnerable release: its dependency edges."""
    bad = g.kind(RELEASE).join(having(g, scope=scope), F.col("node_id") == F.col("owner"), "left_semi")
    return _filled(bad, g.label(NEEDS).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("dependencies")), "dependencies")


def normalised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, centrality: degree on the simple digraph over one less than the number of nodes."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("node_id"))
    counts = ends.groupBy("node_id").agg(F.count("*").alias("d"))
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").crossJoin(F.broadcast(n)).select("node_id", F.coalesce(F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)), F.lit(1.0)).alias("centrality"))


def in_out(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """node_id, outdegree, degree on the simple digraph that the vertices induce; zero where isolated."""
    kept = induced(edges, vertices).select("src", "dst").distinct()
    ends = kept.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("node_id").agg(F.sum("o").alias("outdegree"), F.count("*").alias("degree"))
    return vertices.select("node_id").join(counts, "node_id", "left").na.fill(0, ["outdegree", "degree"])


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices: two semi-joins."""
    v = vertices.select("node_id")
    return edges.join(v, F.col("src") == F.col("node_id"), "left_semi").join(v, F.col("dst") == F.col("node_id"), "left_semi")


def top(df: DataFrame, score: str, k: int = 10, tie: str = "node_seq") -> DataFrame:
    """The k largest with their rank; ties in node order."""
    best = df.orderBy(F.desc(score), tie).limit(k)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))  # k rows


def named(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """A top-k with the nodes' ids in place of node_id; nodes without an id are left out."""
    return nodes.where(F.col("id").isNotNull()).select("node_id", "id").join(F.broadcast(ranked), "node_id")
