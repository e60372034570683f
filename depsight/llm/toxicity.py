"""Toxicity by weak supervision.

Voters are lexicons and patterns: word lists that mark toxic text in either half of a bounded labelled sample, word
beginnings, a fixed list of insults, and patterns of the marked words in a text (see Voters). The votes of every document of the
learning fold are counted by pattern (at most 2^voters counts), and a generative model with a hidden class explains
the counts: EM estimates each voter's rates in either class, voters that stay correlated within the classes are put
into cliques with a joint table, and EM runs again. The model's posteriors label a bounded sample, on which a linear
classifier over hashed words and word beginnings is trained; that classifier alone scores all texts.

Defined results: null and empty texts have no marked words and the score of the bias; without toxic and clean labels
the fixed list is the only voter, and without any vote scores are the share of toxic labels (0 without labels);
repeated rows and null ids are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, cut, id_text
from .labelled import fold, sample

SAMPLE, TRAIN, BUCKETS = 6000, 6000, 1 << 18
STEMS, LIFT, WEAK, LEAST, CLIQUE, TIED = (4, 5, 6), 20.0, 14.0, 4, 3, 0.25
#: Share of marked words that is dense, and how many words apart marked ones are close.
SHARE, NEAR = 0.01, 5
#: A plain list of common English insults.
INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk garbage hate ugly".split())
WORDS = re.compile(r"\w+").findall


def marks(rows: list[tuple[str, float]]) -> tuple[list[str], list[str], list[str]]:
    """Words that are LIFT times as common in toxic documents as in others, words that are WEAK times so, and word
    beginnings that are LIFT times so."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    forms: dict[str, set[str]] = defaultdict(set)
    total = Counter()
    for text, y in rows:
        words = set(WORDS(text.lower()))
        stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
        seen[y >= 0.5].update(words | stems)
        total[y >= 0.5] += 1
        if y >= 0.5:
            for w in words:
                for n in STEMS:
                    if len(w) > n and len(forms[w[:n] + "*"]) < 9:
                        forms[w[:n] + "*"].add(w)
    if not total[True] or not total[False]:
        return [], [], []
    lift = {k: (n / total[True]) / ((seen[False][k] + 0.5) / total[False]) for k, n in seen[True].items() if n >= LEAST}
    strong = sorted(k for k, v in lift.items() if v >= LIFT)
    stems: list[str] = []
    for k in sorted((k for k in strong if k.endswith("*")), key=len):
        if len(forms[k]) >= 5 and not any(k.startswith(s[:-1]) for s in stems):
            stems.append(k)
    words = [k for k in sorted(lift) if not k.endswith("*") and lift[k] >= WEAK and not any(k.startswith(s[:-1]) for s in stems)]
    return [k for k in words if lift[k] >= LIFT], [k for k in words if lift[k] < LIFT], stems


class Voters:
    """Each votes by a source of its own and gives one bit; bit sets are ints. WORD: a lexicon of strong words and one
    of weaker ones, the beginnings of words, the fixed list. TEXT: how dense marked words are, whether several
    different ones occur, whether some stand close together, whether one is written in capitals."""

    WORD, TEXT = ("strong", "weak", "beginnings", "list"), ("dense", "several", "close", "capitals")

    def __init__(self, strong: list[str], weak: list[str], stems: list[str]):
        self.word = dict.fromkeys(weak, 2) | dict.fromkeys(strong, 1)
        self.stem = {s[:-1] for s in stems}
        self.count = len(self.WORD) + len(self.TEXT)

    def caster(self):
        first = len(self.WORD)
        dense, several, close, capitals = (1 << (first + k) for k in range(len(self.TEXT)))

        def of(word: str) -> int:
            w = word.lower()
            return self.word.get(w, 0) | any(w[:n] in self.stem for n in STEMS if len(w) > n) << 2 | (w in INSULTS) << 3

        memo = Memo(of)

        def votes(text: str) -> int:
            words = WORDS(text)
            cast = list(map(memo.__getitem__, words))
            at = [k for k, v in enumerate(cast) if v]
            out = 0
            for k in at:
                out |= cast[k]
            if at:
                out |= dense * (len(at) > SHARE * len(words)) | close * any(b - a <= NEAR for a, b in zip(at, at[1:]))
                out |= several * (len({words[k].lower() for k in at}) > 1) | capitals * any(words[k].isupper() for k in at)
            return out

        return votes


class LabelModel:
    """Hidden class with cliques of voters; fitted by EM to counts of vote patterns."""

    def __init__(self, voters: int):
        self.cliques = [[j] for j in range(voters)]

    def _codes(self, bits: np.ndarray) -> list[np.ndarray]:
        return [sum(bits[:, j].astype(int) << k for k, j in enumerate(c)) for c in self.cliques]

    def fit(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 50) -> np.ndarray:
        """patterns: 0/1 rows; start: first posteriors. Returns the posteriors; keeps rates (P(vote | class)) and prior."""
        post, n = start.copy(), counts.sum()
        codes = self._codes(patterns)
        for _ in range(rounds):
            w1, w0 = counts * post, counts * (1 - post)
            self.prior = float((w1.sum() + 1) / (n + 2))
            self.parts = []  # each clique's log odds, by pattern
            for c, code in zip(self.cliques, codes):
                size = 1 << len(c)
                p1 = (np.bincount(code, w1, size) + 0.1) / (w1.sum() + 0.1 * size)
                p0 = (np.bincount(code, w0, size) + 0.1) / (w0.sum() + 0.1 * size)
                self.parts.append(np.log(p1 / p0)[code])
            new = self._posterior(len(post), self.parts)
            if np.abs(new - post).max() < 1e-6:
                post = new
                break
            post = new
        w1, w0 = counts * post, counts * (1 - post)
        self.rates = np.array([[(patterns[:, j] * w).sum() / max(w.sum(), 1e-9) for w in (w1, w0)] for j in range(patterns.shape[1])])
        return post

    def _posterior(self, n: int, parts: list[np.ndarray]) -> np.ndarray:
        odds = sum(parts, np.full(n, math.log(self.prior / (1 - self.prior))))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def tie(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        """Cliques of at most CLIQUE voters that are correlated within a class.

        Each pair is judged by the posteriors that the other voters give: with its own votes, a pair that copies one
        another becomes the class, and nothing is left of its dependence.
        """
        voters = patterns.shape[1]
        strength = np.zeros((voters, voters))
        for i in range(voters):
            for j in range(i + 1, voters):
                post = self._posterior(len(patterns), [p for c, p in zip(self.cliques, self.parts) if i not in c and j not in c])
                for w in (counts * post, counts * (1 - post)):
                    if w.sum() > 1:
                        (a, b), share = (np.average(patterns[:, k], weights=w) for k in (i, j)), w.sum() / counts.sum()
                        sd = math.sqrt(max(a * (1 - a) * b * (1 - b), 0.0))
                        if sd > 1e-8:
                            rho = abs(np.average(patterns[:, i] * patterns[:, j], weights=w) - a * b) / sd
                            strength[i, j] = max(strength[i, j], rho * share**0.25)
        self.correlations, of = strength, {j: [j] for j in range(voters)}
        for k in np.argsort(-strength, axis=None):
            i, j = divmod(int(k), voters)
            if strength[i, j] > TIED and of[i] is not of[j] and len(of[i]) + len(of[j]) <= CLIQUE:
                both = of[i] + of[j]
                for v in both:
                    of[v] = both
        self.cliques = [sorted(c) for c in {id(c): c for c in of.values()}.values()]


def keys(text: str) -> Counter:
    """Hashed words and word beginnings of a text."""
    memo = _KEYS
    out: Counter = Counter()
    for found in map(memo.__getitem__, WORDS(text)):
        out.update(found)
    return out


def _word_keys(word: str) -> tuple[int, ...]:
    w = word.lower()
    return tuple(zlib.crc32(k.encode()) % BUCKETS for k in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)))


_KEYS = Memo(_word_keys)


class Linear:
    """Logistic regression over the keys that matter, each valued one plus the log of its count."""

    def __init__(self, bias: float = -4.0):
        self.weights, self.bias = {}, bias

    @classmethod
    def learn(cls, rows: list[tuple[str, float]], rounds: int = 1000, rate: float = 1.0, ridge: float = 1e-5) -> Linear:
        y = np.array([p for _, p in rows])
        if not len(y) or y.sum() < 1e-3 * len(y):
            return cls()
        counted, in1, in0 = [], np.zeros(BUCKETS), np.zeros(BUCKETS)
        for text, p in rows:
            c = keys(text)
            own = np.fromiter(c.keys(), np.int32, len(c))  # arrays, as counters of all rows would fill the driver
            counted.append((own, np.fromiter(c.values(), np.int32, len(c))))
            (in1 if p >= 0.5 else in0)[own] += 1
        _KEYS.clear()
        _KEYS.old = {}
        n1, n0 = max(1, int((y >= 0.5).sum())), max(1, int((y < 0.5).sum()))
        ratio = np.log(((in1 + 0.5) / (n1 + 1)) / ((in0 + 0.5) / (n0 + 1)))
        chosen = np.flatnonzero((in1 >= 3) & (ratio > math.log(15.0)))
        at = np.full(BUCKETS, -1)
        at[chosen] = np.arange(len(chosen))
        rws = np.concatenate([np.full(len(k), r) for r, (k, _) in enumerate(counted)])
        cols, vals = at[np.concatenate([k for k, _ in counted])], 1 + np.log(np.concatenate([n for _, n in counted]))
        rws, cols, vals = rws[cols >= 0], cols[cols >= 0], vals[cols >= 0]
        w, bias, vel, vb = np.zeros(len(chosen)), -2.0, np.ones(len(chosen)) * 1e-6, 1e-6
        for _ in range(rounds):
            z = np.bincount(rws, vals * w[cols], len(y)) + bias if len(rws) else np.full(len(y), bias)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
            g = np.bincount(cols, vals * err[rws], len(chosen)) + ridge * w if len(rws) else w * 0
            vel += g * g
            w -= rate * g / np.sqrt(vel)
            vb += err.sum() ** 2
            bias -= rate * err.sum() / math.sqrt(vb)
        self = cls(float(bias))
        self.weights = {int(k): float(v) for k, v in zip(chosen, w) if abs(v) > 1e-3}
        return self

    def scorer(self):
        weights = self.weights
        memo = Memo(lambda word: tuple(k for k in _word_keys(word) if k in weights))

        def score(text: str) -> float:
            found = Counter(k for ks in map(memo.__getitem__, WORDS(text)) if ks for k in ks)
            z = self.bias + sum(weights[k] * (1 + math.log(n)) for k, n in found.items())
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> tuple[Linear, LabelModel]:
    texts, spark = id_text(docs), docs.sparkSession
    open_fold = fold(F.col("doc_id"), folds) != held
    known = sample(texts, labels, "toxic", open_fold, SAMPLE, "toxic")
    voters = Voters(*marks(known))
    sent = spark.sparkContext.broadcast(voters)

    def cast(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = sent.value.caster()
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([votes(t) for t in b.column("text").to_pylist()], pa.int32())], ["doc_id", "votes"])

    cast_votes = cut(texts.where(open_fold).mapInArrow(cast, "doc_id long, votes int"))
    counts = cast_votes.groupBy("votes").count().collect()  # 2^voters at most
    model = LabelModel(voters.count)
    if not counts:
        return Linear(), model
    codes, n = np.array([r["votes"] for r in counts]), np.array([float(r["count"]) for r in counts])
    bits = ((codes[:, None] >> np.arange(voters.count)) & 1).astype(float)
    fired = bits.sum(1)
    start = np.where(fired == 0, 0.01, 0.6 + 0.3 * np.minimum(fired, 3) / 3)
    model.fit(bits, n, start)
    model.tie(bits, n)
    post = model.fit(bits, n, start)  # anew, as the first fit may have made a copied voter the class
    believed = F.broadcast(spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "votes int, y double"))
    order = F.xxhash64(F.lit("train"), "doc_id")
    with_y = cast_votes.join(believed, "votes").where("doc_id is not null")
    parts = [with_y.where(side).orderBy(order, "doc_id").limit(TRAIN // 2) for side in (F.col("y") >= 0.5, F.col("y") < 0.5)]
    ids = parts[0].unionByName(parts[1]).dropDuplicates(["doc_id"])
    rows = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y").collect()  # TRAIN rows at most
    return Linear.learn([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]), model


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds, held)[0])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    out = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
