"""Column types of the property graph and of its decoded attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

NODES = "node_seq long, node_id string, labels string, id string, version string, timestamp string, type string, value string"
EDGES = "edge_seq long, src string, dst string, label string"
CVE = "cve array<struct<cwe: string, severity: string, name: string>>"
FRESHNESS = "freshness struct<numberMissedRelease: string, outdatedTimeInMs: string>"
CVE_DOCUMENT = "map<string, array<struct<name: string, cwe_ids: string>>>"

ARTIFACT, RELEASE, ADDED = ":Artifact", ":Release", ":AddedValue"
OWNS, NEEDS, HAS = "relationship_AR", "dependency", "addedValues"
KINDS = ("CVE", "FRESHNESS", "POPULARITY_1_YEAR", "SPEED")
#: Scores of severities; any other has 0.
SEVERITY = {"CRITICAL": 4, "HIGH": 3, "MODERATE": 2, "LOW": 1}
MS_PER_DAY = 86_400_000.0


@dataclass(frozen=True)
class Graph:
    """Labelled property graph: nodes and edges in the orders node_seq and edge_seq."""

    nodes: DataFrame
    edges: DataFrame

    def label(self, name: str) -> DataFrame:
        return self.edges.where(self.edges["label"] == name)

    def kind(self, labels: str) -> DataFrame:
        return self.nodes.where(self.nodes["labels"] == labels)
