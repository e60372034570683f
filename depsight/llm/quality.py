"""Quality classifier: supervised subword embeddings.

Every word has a hashed vector and hashed vectors of its character n-grams; a word's vector is their mean, a
document's the mean over its words, and a softmax layer gives the classes. All vectors are learned by stochastic
gradient descent in numpy, on at most SAMPLE labelled documents. A repeat of the word before counts as a word of its
own (REPEAT), so runs of one word show whatever the word. As the model is linear after the averages, a word's share of
the score is one number, remembered by each worker; scoring reads every whole text once.

Defined results: null and empty texts are scored by the bias alone; without labels of both classes all scores are the
mean label (0.5 without any); null ids are scored; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, id_text
from .labelled import fold, sample

SAMPLE, BUCKETS, DIM, EPOCHS, RATE, REPEAT, GRAMS = 4000, 1 << 17, 12, 6, 8.0, "\x00repeat", (3, 4)


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams with marked ends."""
    if word == REPEAT:
        return [0]
    b, marked = zlib.crc32, f"<{word}>".encode()
    out = [b(marked) % BUCKETS]
    for n in GRAMS:
        out += [b(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def counted(text: str) -> Counter:
    words = text.split()
    found = Counter(words)
    if again := sum(map(eq, words, words[1:])):
        found[REPEAT] = again
    return found


class Subwords:
    def __init__(self, prior: float = 0.5):
        self.table, self.bias = None, math.log(min(max(prior, 1e-6), 1 - 1e-6) / (1 - min(max(prior, 1e-6), 1 - 1e-6)))

    @classmethod
    def learn(cls, rows: list[tuple[str, float]], seed: int = 1) -> Subwords:
        if not rows or len({y >= 0.5 for _, y in rows}) < 2:
            return cls(float(np.mean([y for _, y in rows])) if rows else 0.5)
        rng, known = np.random.default_rng(seed), Memo(lambda w: np.array(features(w), np.int32), 1 << 19)
        made = []
        for text, y in rows:
            c = counted(text)
            if not c:
                continue
            total = sum(c.values())
            ids = [known[w] for w in c]
            weight = np.repeat([n / total / len(i) for n, i in zip(c.values(), ids)], [len(i) for i in ids])
            ids, where = np.unique(np.concatenate(ids), return_inverse=True)
            made.append((ids, np.bincount(where, weight).astype(np.float32), y))
        known.clear()
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        steps, done = EPOCHS * len(made), 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(made)):
                ids, w, y = made[k]
                rate = RATE * (1 - done / steps)
                done += 1
                e = vectors[ids]
                hidden = w @ e
                logit = hidden @ out + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                err = p - np.array([1 - y, y], np.float32)
                back = out @ err
                out -= 0.1 * rate * np.outer(hidden, err)
                bias -= 0.01 * rate * err
                vectors[ids] = e - rate * w[:, None] / max(float(w @ w), 1e-3) * 0.1 * back
        self = cls()
        self.table, self.bias = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])
        return self

    def scorer(self):
        if self.table is None:
            flat = 1 / (1 + math.exp(-self.bias))
            return lambda text: flat
        table = self.table.tolist()

        def of(word: str) -> float:
            f = features(word)
            return sum([table[i] for i in f]) / len(f)

        memo = Memo(of)
        again, share, bias = memo[REPEAT], memo.__getitem__, self.bias

        def score(text: str) -> float:
            words = text.split()
            n = len(words)
            if not n:
                return 1 / (1 + math.exp(-bias))
            repeats = sum(map(eq, words, words[1:]))
            z = (sum(map(share, words)) + repeats * again) / (n + repeats) + bias
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = SAMPLE) -> Subwords:
    return Subwords.learn(sample(id_text(docs), labels, "quality", fold(F.col("doc_id"), folds) != held, most, "quality"))


def scored(docs: DataFrame, model: Subwords) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs, learn(docs, labels, folds, held))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds, held))

    def keep(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for b in batches(it):
            yield b.filter(pa.array([score(t or "") >= threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
