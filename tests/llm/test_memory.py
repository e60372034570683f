"""What Python workers hold when they go on to other work."""

import time

import pyarrow as pa

from depsight.llm import common, pieces
from depsight.llm.queries import tokenizer_path

from . import cases


def test_idle_workers_forget_their_lattices(spark):
    docs = cases.frame(spark, [(k, cases.words(20, k)) for k in range(40)]).repartition(4)
    assert pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")).where("round_trip").count() == 40

    def held(it):
        n = sum(b.num_rows for b in it)
        time.sleep(0.5)  # so that all workers get a task
        yield pa.RecordBatch.from_arrays([pa.array([len(pieces.MODELS)] * bool(n), pa.int64())], ["n"])

    look = lambda: [r["n"] for r in spark.range(0, 4, 1, 4).mapInArrow(held, "n long").collect()]
    time.sleep(pieces.IDLE + 1)
    assert look() == [0] * 4


def test_a_worker_at_work_keeps_its_lattice(monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "IDLE", 0.3)
    one = pieces.Lattice.of(path)
    one.rest()
    assert pieces.Lattice.of(path) is one
    time.sleep(0.6)
    assert pieces.Lattice.of(path) is one
    one.rest()
    time.sleep(0.6)
    assert not pieces.MODELS


def test_batches_give_back_what_the_pool_keeps(monkeypatch):
    calls, pool = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            calls.append(pool.release_unused())

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    whole = [pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"]) for _ in range(3)]
    assert [b.num_rows for b in common.batches(whole, 600)] == [600, 400] * 3 and len(calls) == 3
