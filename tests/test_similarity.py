import math

from depsight.operators import similarity as S

ROWS = [("g:core:1.0", "CVE-1", "[CWE-20,CWE-79]"), ("g:core:1.0", "CVE-2", "[CWE-20]"), ("g:web:1.0", "CVE-1", "[CWE-79]"), ("g:util:1.0", "UNKNOWN", "UNKNOWN"), ("g:util:1.0", "CVE-3", "[CWE-20]")]


def entries(spark):
    return spark.createDataFrame(ROWS, "release string, name string, cwe_ids string")


def test_counts_and_pairs(spark):
    d = entries(spark)
    assert {(r["key"], r["n"]) for r in S.counts(S.cwe_packs(d)).collect()} == {("CWE-20", 3), ("CWE-79", 2)}
    assert {(r["a"], r["b"]): r["sim"] for r in S.pairs(S.cve_packs(d)).collect()} == {("CVE-1", "CVE-2"): 0.5, ("CVE-3", "UNKNOWN"): 1.0}
    assert math.isclose(S.pairs(S.cwe_packs(d)).first()["sim"], 1 / 3)


def test_thresholds(spark):
    rows = {round(r["threshold"], 1): r for r in S.thresholds(S.cve_packs(entries(spark))).collect()}
    assert rows[0.4]["above"] == 2 and math.isclose(rows[0.4]["percent"], 100 / 3)
    assert rows[0.5]["above"] == 1 and rows[0.5]["total"] == 6
    percents = [rows[k / 10]["percent"] for k in range(1, 10)]
    assert percents == sorted(percents, reverse=True)
    one = S.thresholds(S.cve_packs(entries(spark).limit(1)))
    assert one.first()["percent"] is None


def test_packages_and_ecosystems(spark):
    d = entries(spark)
    assert {r["release"] for r in S.packages(d).collect()} == {"g:core", "g:web", "g:util"}
    got = {r["eco"]: (r["releases"], r["max"]) for r in S.ecosystem_stats(d, [("core", "Core"), ("g:", "Rest")]).collect()}
    assert got == {"Core": (1, 2), "Rest": (2, 2)}
