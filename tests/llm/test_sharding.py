import re
import zlib
from collections import Counter

from depsight.llm import sharding

from . import cases


def check(rows, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in out)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in out} <= {"rows"} and {r["grown_shard"] for r in out} <= {None}


def test_law_of_rows(spark):
    rows = cases.texts() + [(1000 + k, f"t{k}") for k in range(700)] + [(7777, "hot")] * 300
    out = sharding.digest(sharding.assign(cases.frame(spark, rows), 40, bucket_rows=32)).collect()
    check(rows, out, 40)
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"])) if (r["doc_id"] or 0) >= 1000]
    assert ids != sorted(ids)


def test_few_rows_and_none(spark):
    rows = cases.texts()[:5]
    check(rows, sharding.digest(sharding.assign(cases.frame(spark, rows), 40)).collect(), 40)
    assert sharding.assign(cases.frame(spark, []), 40).count() == 0


def places(spark, df, tmp=""):
    return Counter((r["row"]["doc_id"], r["row"]["text"], r["shard"], r["slot"]) for r in sharding.assign(df, 9, bucket_rows=50).collect())


def test_place_hangs_on_the_rows_alone(spark):
    rows = [(k, f"t{k}") for k in range(300)] + [(None, "again")] * 90 + [(5, None)] * 3
    a = cases.frame(spark, rows)
    one = places(spark, a)
    assert one == places(spark, a.repartition(5)) == places(spark, cases.frame(spark, rows[::-1]).coalesce(1))
    assert len({s for _, t, s, _ in one if t == "again"}) == 9
    assert places(spark, cases.frame(spark, rows[:300])) == places(spark, cases.frame(spark, rows[:300]).repartition(3))


def plain_fisher_yates(draws):
    a = list(range(len(draws)))
    for i in range(len(a) - 1, 0, -1):
        j = draws[i - 1]
        a[i], a[j] = a[j], a[i]
    return a


def test_fisher_yates_is_uniform_and_seeded(spark):
    block, draws, fold = sharding._permutation(5)
    make = lambda frame: frame.selectExpr("*", f"{block} AS b", f"{draws} AS draws").selectExpr("draws", f"{fold} AS perm").collect()
    perms = [tuple(r["perm"]) for r in make(spark.range(3000).selectExpr("int(id) AS bucket", "4 AS n"))]
    assert all(sorted(p) == [0, 1, 2, 3] for p in perms)
    seen = Counter(perms)
    assert len(seen) == 24 and max(seen.values()) < 2 * 3000 / 24 and min(seen.values()) > 0.5 * 3000 / 24
    for r in make(spark.range(1, 90).selectExpr("int(id) AS bucket", "int(id) AS n")):
        assert r["perm"] == plain_fisher_yates(r["draws"])


def test_written_shards(spark, tmp_path):
    rows = [(k, f"t{k}") for k in range(100)]
    name = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), 7)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert name == "shard" and back.count() == 100 and back.select("shard").distinct().count() == 7
    assert back.columns == ["doc_id", "text", "shard"]
    frame = cases.frame(spark, rows)
    name = sharding.write_shards(frame, str(tmp_path / "t"), 7)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert name == "shard_" and back.columns == [*frame.columns, "shard_"] and back.select("shard_").distinct().count() == 7
    order = {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(frame, 7).collect()}
    for k in range(7):
        files = sorted((tmp_path / "t" / f"shard_={k}").glob("*.parquet"))
        ids = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert [order[i] for i in ids] == sorted(order[i] for i in ids) and len(ids) in (14, 15)


def test_no_python_in_the_plan(spark):
    plan = sharding.digest(sharding.assign(cases.frame(spark), 40))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
