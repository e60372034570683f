"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed, scratch_path


cut = checkpointed


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; no other column of the input matters."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def batches(it: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that decoded texts stay few at a time. What Arrow's pool keeps of earlier
    batches goes back to the system."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """A dict that computes what it lacks; at its limit it keeps what was asked since the limit before."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def sorted_runs(it: Iterable[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole runs of equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if start == 0 and held and held[-1].column(key)[-1].as_py() == keys[0]:
            held.append(b)
            continue
        if start:
            held.append(b.slice(0, start))
        if held:
            yield _columns(held)
        held = [b.slice(start)]
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(held)
    return {n: t.column(n).to_numpy() for n in t.column_names}


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) longs -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star; each round ends in a reliable checkpoint. Rows of a hub are only
    joined with its minimum, which AQE can split; no group is gathered. Nodes without an edge are absent.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spool(df: DataFrame, name: str = "spool") -> DataFrame:
    """Written to the shared folder as Parquet and read back: lineage ends, and later readers share one result."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def free(*spooled: DataFrame) -> None:
    """Delete spools that nothing will read again, and let Spark's cleaner drop the shuffle files of finished queries."""
    jvm, conf = spooled[0].sparkSession.sparkContext._jvm, spooled[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for df in spooled:
        path = jvm.org.apache.hadoop.fs.Path(df.spooled)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()
