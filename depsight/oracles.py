"""The queries' SQL for DuckDB, on a graph rebuilt there from the same tables."""

from __future__ import annotations

REL = """
rel AS MATERIALIZED (
  SELECT o_orderkey AS o, epoch_ms(o_orderdate) AS ts, min(l_partkey) AS owner, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
)"""

GRAPH = f"""{REL},
cl AS (
  SELECT l_orderkey AS o, string_agg('{{"cwe":"[CWE-' || l_linenumber || ',CWE-' || (l_suppkey % 7 + 20) || ']","severity":"' ||
    (['CRITICAL','HIGH','MODERATE','LOW','WEIRD'])[l_linenumber % 5 + 1] || '","name":"CVE-' || l_suppkey || '"}}', ',' ORDER BY l_linenumber, l_suppkey) AS body
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
),
parts AS (SELECT l_partkey AS p, count(*) * 1000 // 365 AS s FROM lineitem GROUP BY l_partkey),
added AS (
  SELECT 'r' || o AS owner, o AS num, 1 AS k, 'CVE' AS type, replace('{{"cve":[' || coalesce(body, '') || ']}}', '"', '\\"') AS value
  FROM rel LEFT JOIN cl USING (o) WHERE body IS NOT NULL OR o % 3 = 0
  UNION ALL SELECT 'r' || o, o, CASE WHEN o % 4 = 0 THEN 0 ELSE 2 END, 'FRESHNESS',
    replace('{{"freshness":{{"numberMissedRelease":"' || n || '","outdatedTimeInMs":"' || (o * 7919 % 1000 * 3600000) || '"}}}}', '"', '\\"') FROM rel WHERE o % 2 = 0
  UNION ALL SELECT 'r' || o, o, 3, 'POPULARITY_1_YEAR', CAST(quantity AS VARCHAR) FROM rel WHERE o % 5 = 0
  UNION ALL SELECT 'a' || p, p, 4, 'SPEED', (s // 1000) || '.' || lpad(CAST(s % 1000 AS VARCHAR), 3, '0') FROM parts WHERE p % 2 = 0
),
nodes AS MATERIALIZED (
  SELECT p_partkey * 16 AS node_seq, 'a' || p_partkey AS node_id, ':Artifact' AS labels, 'grp:a' || p_partkey AS id, NULL::VARCHAR AS version, NULL::VARCHAR AS timestamp, NULL::VARCHAR AS type, NULL::VARCHAR AS value FROM part
  UNION ALL SELECT o * 16 + (1::BIGINT << 50), 'r' || o, ':Release', 'grp:a' || owner || ':' || o, CAST(o AS VARCHAR), CAST(ts AS VARCHAR), NULL, NULL FROM rel
  UNION ALL SELECT num * 16 + k + (1::BIGINT << 51), owner || ':v' || k, ':AddedValue', owner || ':' || type, NULL, NULL, type, value FROM added
),
edges AS MATERIALIZED (
  SELECT num * 16 + k AS edge_seq, owner AS src, owner || ':v' || k AS dst, 'addedValues' AS label FROM added
  UNION ALL SELECT DISTINCT o * (1::BIGINT << 28) + l_partkey + (1::BIGINT << 58), 'r' || o, 'a' || l_partkey, 'dependency' FROM rel JOIN lineitem ON l_orderkey = o WHERE l_partkey <> owner
  UNION ALL SELECT o + (1::BIGINT << 61), 'a' || owner, 'r' || o, 'relationship_AR' FROM rel
),
att AS MATERIALIZED (SELECT e.src AS owner, e.edge_seq, n.type, n.value FROM edges e JOIN nodes n ON e.dst = n.node_id WHERE e.label = 'addedValues' AND n.type IS NOT NULL),
fst AS MATERIALIZED (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY owner ORDER BY edge_seq) = 1),
cvx AS (
  SELECT owner, edge_seq, CASE WHEN type = 'CVE' THEN json_array_length(replace(value, '\\"', '"'), '$.cve') ELSE 0 END AS n, type FROM att
),
strict AS MATERIALIZED (SELECT f.owner FROM fst f JOIN cvx c USING (owner, edge_seq) WHERE f.type = 'CVE' AND c.n > 0),
strict_any AS (SELECT DISTINCT owner FROM cvx WHERE type = 'CVE' AND n > 0),
typed AS (SELECT owner FROM fst WHERE type = 'CVE'),
ent AS (
  SELECT owner, unnest(from_json(json_extract(replace(value, '\\"', '"'), '$.cve'), '[{{"cwe":"VARCHAR","severity":"VARCHAR","name":"VARCHAR"}}]')) AS c FROM att WHERE type = 'CVE'
),
sev AS MATERIALIZED (
  SELECT t.owner, CAST(coalesce(sum(CASE WHEN c.severity = 'CRITICAL' THEN 4 WHEN c.severity = 'HIGH' THEN 3 WHEN c.severity = 'MODERATE' THEN 2 WHEN c.severity = 'LOW' THEN 1 ELSE 0 END), 0) AS BIGINT) AS severity,
    count(c) AS cves FROM typed t LEFT JOIN ent USING (owner) GROUP BY t.owner
),
own AS (SELECT dst AS release, max_by(src, edge_seq) AS artifact FROM edges WHERE label = 'relationship_AR' GROUP BY dst),
rng AS (
  SELECT release, artifact, coalesce(try_cast(timestamp AS BIGINT), 0) AS lo, lead(coalesce(try_cast(timestamp AS BIGINT), 0)) OVER (PARTITION BY artifact ORDER BY coalesce(try_cast(timestamp AS BIGINT), 0), node_seq) AS hi
  FROM own JOIN nodes ON release = node_id AND labels = ':Release'
),
dep AS (SELECT src, dst AS artifact FROM edges WHERE label = 'dependency'),
withattr AS (
  SELECT owner FROM fst WHERE type IN ('CVE', 'FRESHNESS', 'POPULARITY_1_YEAR', 'SPEED')
  UNION SELECT node_id FROM nodes WHERE coalesce(try_cast(timestamp AS BIGINT), 0) <> 0
),
qty AS (
  SELECT owner, max_by(try_cast(value AS BIGINT), edge_seq) FILTER (type = 'POPULARITY_1_YEAR') AS popularity,
    max_by(try_cast(json_extract_string(replace(value, '\\"', '"'), '$.freshness.numberMissedRelease') AS BIGINT), edge_seq) FILTER (type = 'FRESHNESS') AS missed,
    max_by(try_cast(json_extract_string(replace(value, '\\"', '"'), '$.freshness.outdatedTimeInMs') AS BIGINT), edge_seq) FILTER (type = 'FRESHNESS') AS ms,
    max_by(try_cast(value AS DOUBLE), edge_seq) FILTER (type = 'SPEED') AS speed
  FROM (SELECT owner, edge_seq, type, CASE WHEN type IN ('CVE', 'FRESHNESS') AND value NOT LIKE '{{%' THEN NULL ELSE value END AS value FROM att) GROUP BY owner
),
iedge AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT owner FROM withattr) AND dst IN (SELECT owner FROM withattr)),
deg AS (SELECT v, count(*) AS degree, sum(o) AS outdegree FROM (SELECT src AS v, 1 AS o FROM iedge UNION ALL SELECT dst, 0 FROM iedge) GROUP BY v),
fea AS (
  SELECT n.node_id, coalesce(q.missed, 0) AS freshness_missrelease, coalesce(q.ms, 0) / 86400000.0::DOUBLE AS freshness_outdays, coalesce(q.popularity, 0) AS popularity, coalesce(q.speed, 0.0::DOUBLE) AS speed,
    coalesce(s.severity, 0) AS severity, CAST(coalesce(d.outdegree, 0) AS BIGINT) AS outdegree, coalesce(d.degree, 0) AS degree
  FROM nodes n JOIN withattr w ON n.node_id = w.owner LEFT JOIN qty q ON q.owner = n.node_id LEFT JOIN sev s ON s.owner = n.node_id LEFT JOIN deg d ON d.v = n.node_id
),
feat AS (SELECT owner, 1 AS e, severity AS s, cves AS c FROM sev)"""

DOC = f"""{REL},
doc AS (
  SELECT 'grp:a' || owner || ':' || o AS release, CASE WHEN l_suppkey % 50 = 0 THEN 'UNKNOWN' ELSE 'CVE-' || l_suppkey END AS name,
    CASE WHEN l_suppkey % 50 = 0 THEN 'UNKNOWN' ELSE '[CWE-' || (l_linenumber + l_suppkey % 5) || ',CWE-' || (l_suppkey % 7 + 20) || ']' END AS cwe_ids
  FROM lineitem JOIN rel ON l_orderkey = o WHERE l_returnflag = 'R'
),
cwe AS (SELECT unnest(regexp_extract_all(cwe_ids, 'CWE-[0-9]+')) AS cwe, release, name FROM doc)"""

TRADE = """
pr AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
),
trade AS (SELECT * FROM pr WHERE cents > (SELECT sum(cents) / count(*) FROM pr) AND src <> dst)"""


def graph(body: str) -> str:
    return f"WITH {GRAPH}\n{body}"


def doc(body: str, more: str = "") -> str:
    return f"WITH {DOC}{', ' + more if more else ''}\n{body}"


def trade(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {TRADE}{', ' + more if more else ''}\n{body}"
