"""Reading and writing labelled property graphs and vulnerability documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CVE_DOCUMENT, EDGES, NODES, Graph

_FIELDS = ("labels", "id", "version", "timestamp", "type", "value")
_DATA = "data array<struct<_key: string, _VALUE: string>>"


class GraphSource(Protocol):
    """Anything that can load a graph; a database connector would implement this."""

    def load(self, spark: SparkSession) -> Graph: ...


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


def _field(name: str):
    """The last value of a key, as a dict keeps it."""
    found = F.filter("data", lambda d: d["_key"] == name)
    return F.get(F.transform(found, lambda d: d["_VALUE"]), F.size(found) - 1)


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """GraphML; node_seq and edge_seq follow the document, a split after another."""
    seq = F.monotonically_increasing_id()
    nodes = _xml(spark, path, "node", f"_id string, {_DATA}").select(seq.alias("node_seq"), F.col("_id").alias("node_id"), *[_field(k).alias(k) for k in _FIELDS])
    edges = _xml(spark, path, "edge", f"_source string, _target string, _label string, {_DATA}")
    return Graph(nodes, edges.select(seq.alias("edge_seq"), F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_label", _field("label")).alias("label")))


def write_graphml(graph: Graph, path: str) -> None:
    """Two XML files sets, path/nodes and path/edges, that read_graphml reads from path/*."""
    data = F.filter(F.array(*[F.struct(F.lit(k).alias("_key"), F.col(k).alias("_VALUE")) for k in _FIELDS]), lambda d: d["_VALUE"].isNotNull())
    graph.nodes.sort("node_seq").select(F.col("node_id").alias("_id"), data.alias("data")).write.format("xml").option("rootTag", "graphml").option("rowTag", "node").save(f"{path}/nodes")
    graph.edges.sort("edge_seq").select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.col("label").alias("_label")).write.format("xml").option("rootTag", "graphml").option("rowTag", "edge").save(f"{path}/edges")


def write_parquet(graph: Graph, path: str) -> None:
    """Sorted by kind and label in each file, so that a filter on them skips the row groups of others."""
    graph.nodes.sortWithinPartitions("labels").write.parquet(f"{path}/nodes")
    graph.edges.sortWithinPartitions("label").write.parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file."""
    return spark.read.option("header", True).csv(path).columns


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column as text."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in header(spark, path)))


def read_cve_document(spark: SparkSession, path: str) -> DataFrame:
    """(release, name, cwe_ids) from one JSON map of releases to their CVE entries."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", CVE_DOCUMENT).alias("m"))
    return whole.select(F.explode("m").alias("release", "cves")).select("release", F.inline("cves"))


def materialized(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What lies at path, or else what make gives, written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or "") and "UNABLE_TO_INFER" not in (e.getCondition() or ""):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """A gapless number in the given order: range-partitioned, counted, then numbered inside each part."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    sizes = parts.groupBy("__p").count()  # a row for each partition
    base = sizes.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__r", own).join(F.broadcast(base), "__p").withColumn(name, F.col("__b") + F.col("__r") - 1).drop("__p", "__b", "__r")
