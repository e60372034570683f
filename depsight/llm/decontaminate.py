"""Benchmark decontamination by SimHash windows.

Texts are words (runs of word characters, lower case) and five-word shingles with their counts as weights (an item of
fewer words is one shingle). A document is read in windows of an item's size at every start; windows that hold too few
of the items' shingles to be similar are passed over at once, which is exact. The others get a SimHash of their
weighted shingles. Fingerprints are cut into BLOCKS equal blocks; within RADIUS bits at least one block is within
RADIUS / BLOCKS, so the blocks guarantee every fingerprint in the radius. Candidates are verified by the exact
weighted Jaccard similarity of their shingles.

Items go to the executors in blocks of at most ITEM_BYTES, each a pass over the documents, so no broadcast grows.

Defined results: null and empty texts and items without words match nothing; a document shorter than an item is one
window; repeated documents are reported each, repeated item rows once; of overlapping windows of an item the most
similar is kept, the first of equals; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, id_text

WIDTH, SIMILAR, BITS, BLOCKS, RADIUS, ITEM_BYTES = 5, 0.8, 64, 8, 23, 8 << 20
WORDS = re.compile(r"\w+").findall
_ROT = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of width words, from the words' hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h = h * _ROT + words[k : n + k]
    return mixed(h)


def signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS)


def packed(votes: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(2 * votes > size, axis=-1)


class Items:
    """Items by width and size; the table of their shingles."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.groups: dict[tuple[int, int], list] = defaultdict(list)
        table: dict[int, set[int]] = defaultdict(set)
        for item_id, text in rows:
            h = np.array([word_hash(w) for w in WORDS((text or "").lower())], np.uint64)
            if len(h):
                width = min(WIDTH, len(h))
                s = shingle_hashes(h, width)
                self.groups[width, len(h)].append((item_id, Counter(s.tolist()), packed(signs(s).sum(0), len(s))))
                table[width].update(s.tolist())
        self.table = {w: np.array(sorted(t), np.uint64) for w, t in table.items()}
        self.seen = {}
        for w, t in self.table.items():
            self.seen[w] = np.zeros(1 << 20, bool)
            self.seen[w][(t >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, s: np.ndarray, width: int) -> np.ndarray:
        maybe, out = np.flatnonzero(self.seen[width][(s >> np.uint64(44)).astype(np.int64)]), np.zeros(len(s), bool)
        t = self.table[width]
        at = np.searchsorted(t, s[maybe])
        out[maybe] = t[np.minimum(at, len(t) - 1)] == s[maybe]
        return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over united weight."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def found(words: np.ndarray, items: Items, similar: float = SIMILAR, radius: int = RADIUS) -> Iterator[tuple[int, int, int, float]]:
    """(item, first word, number of words, similarity) of the best windows of each item that do not overlap."""
    per_block = radius // BLOCKS
    hashed: dict[int, tuple] = {}
    for (width, size), group in items.groups.items():
        if width not in hashed:
            s = shingle_hashes(words, width)
            hit = items.hits(s, width) if len(s) else np.zeros(0, bool)
            hashed[width] = (s, np.append(0, np.cumsum(hit)), None)
        s, hits, votes = hashed[width]
        m = size - width + 1  # shingles of a whole window
        k = min(m, len(s))
        # shared <= hits, and shared / (m + k - shared) >= similar must be possible
        least = similar * (m + k) / (1 + similar)
        if k < 1 or hits[-1] < least - 1e-9:
            continue
        starts = np.flatnonzero(hits[k:] - hits[:-k] >= least - 1e-9)
        if not len(starts):
            continue
        if votes is None:
            votes = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(s), axis=0, dtype=np.int32)])
            hashed[width] = (s, hits, votes)
        prints = packed(votes[starts + k] - votes[starts], k)
        for item_id, weights, print_ in group:
            far = np.bitwise_count(prints ^ print_)
            close = (far <= per_block).any(axis=1)
            close[close] = far[close].sum(axis=1) <= radius
            good = []
            for at in starts[close]:
                sim = similarity(Counter(s[at : at + k].tolist()), weights)
                if sim >= similar:
                    good.append((-sim, int(at)))
            taken: list[int] = []
            for neg, at in sorted(good):
                if all(abs(at - t) >= size for t in taken):
                    taken.append(at)
                    yield item_id, at, k + width - 1, -neg


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of bounded size, streamed to the driver."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 64
        if size > ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the contaminated windows."""
    schema, spark = "doc_id long, item_id long, first_word long, n_words long, similarity double", docs.sparkSession
    names = [f.split()[0] for f in schema.split(", ")]
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(it: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, memo = Items(sent.value), Memo(word_hash, 100_000)
            of = memo.__getitem__
            for b in batches(it):
                got = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    h = np.fromiter(map(of, WORDS(text.lower())), np.uint64)
                    got += [(doc_id, *x) for x in found(h, known, similar, radius)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, zip(*got))], names)

        part = id_text(docs).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """The documents without a contaminated window, all columns kept."""
    schema = docs.schema
    out = docs
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(it: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, memo = Items(sent.value), Memo(word_hash, 100_000)
            of = memo.__getitem__
            for b in batches(it):
                fine = []
                for text in b.column("text").to_pylist():
                    h = np.fromiter(map(of, WORDS((text or "").lower())), np.uint64)
                    fine.append(next(found(h, known, similar, radius), None) is None)
                yield b.filter(pa.array(fine, pa.bool_()))

        out = out.mapInArrow(keep, schema)
    return out
