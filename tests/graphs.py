"""A small package graph with attributes of every kind."""

from __future__ import annotations

import json

from depsight.schema import EDGES, NODES, Graph

OWNERS = [("r1", "a1", 100), ("r2", "a1", 200), ("r3", "a2", 150), ("r4", "a2", 250), ("r5", "a3", 120)]
NEEDED = [("r1", "a3"), ("r2", "a3"), ("r3", "a1"), ("r4", "a1"), ("r4", "a3"), ("r5", "a2")]


def cves(*severities: str) -> str:
    return json.dumps({"cve": [{"cwe": "[CWE-20]", "severity": s, "name": f"CVE-{i}"} for i, s in enumerate(severities)]}).replace('"', '\\"')


FRESH = json.dumps({"freshness": {"numberMissedRelease": "7", "outdatedTimeInMs": "3795765000"}}).replace('"', '\\"')
ADDED = [
    ("r1", "v1", "CVE", cves("HIGH", "LOW")), ("r2", "v2", "CVE", cves()), ("r3", "v3", "FRESHNESS", FRESH), ("r3", "v4", "CVE", cves("CRITICAL")),
    ("r4", "v5", "CVE", cves("MODERATE", "WEIRD")), ("a1", "v6", "SPEED", "0.5"), ("r5", "v7", "POPULARITY_1_YEAR", "0"),
]


def graph(spark) -> Graph:
    nodes = [(a, ":Artifact", f"g:{a}", None, None, None, None) for a in ("a1", "a2", "a3")]
    nodes += [(r, ":Release", f"g:{a}:{r}", r, str(t), None, None) for r, a, t in OWNERS]
    nodes += [(v, ":AddedValue", f"{o}:{k}", None, None, k, x) for o, v, k, x in ADDED]
    edges = [(a, r, "relationship_AR") for r, a, _ in OWNERS] + [(r, a, "dependency") for r, a in NEEDED] + [(o, v, "addedValues") for o, v, _, _ in ADDED]
    return Graph(spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], NODES), spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], EDGES))


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}
