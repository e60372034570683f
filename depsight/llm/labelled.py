"""Labelled samples for the classifiers: bounded, chosen by hash order, from the learning fold only."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, seed: str) -> list[tuple[str, float]]:
    """At most ``most`` (text, label) of documents that ``learn`` admits, the first by hash of their id.

    A document with several label rows has their mean. docs: doc_id and text, text not null.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").where(learn)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = known.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y").collect()  # `most` ids at most
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
