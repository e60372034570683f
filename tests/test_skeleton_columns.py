from depsight import queries as Q


def test_skeleton_and_discovery_see_the_scores(spark):
    rows = [(1, k % 2, 1, 1, k % 2, 1) for k in range(200)]
    p = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in Q.ALLCOLS))
    assert [tuple(r) for r in Q.m9(p).collect()] == [("node_cve_score", "neighbor_cve_score")]
    assert Q.m11(p).first()["edges"] == 1
