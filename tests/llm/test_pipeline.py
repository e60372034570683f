import corpus_pipeline as P
from depsight.llm.common import spool

from . import cases


def test_stages_on_a_small_folder(spark, tmp_path):
    rows = [(k, cases.words(60, k)) for k in range(60)]
    item = cases.words(30, 999)
    rows += [(100, rows[3][1]), (101, cases.words(20, 5000) + " " + item), (102, None), (103, "")]
    rows += [(200 + k, " ".join(w.upper() + "!!" for w in cases.words(50, 300 + k).split())) for k in range(20)]
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = spool(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not left[0] & set(range(200, 220)) and set(range(60)) <= left[0]
    assert left[1] == left[0]
    assert 100 not in left[2] and 3 in left[2]
    assert 101 not in left[3] and set(range(60)) <= left[3]
    out = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == left[3] and all(r["round_trip"] for r in out)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
