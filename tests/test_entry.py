import __spark_entry__ as entry


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert {"a2_software_cve", "j5_interval_dependencies", "g1_betweenness", "m9_skeleton"} <= set(known)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["node_id", "releases"]
