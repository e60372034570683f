"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are compared within a Hamming radius. Correlated bits are grouped into partitions; each partition
gets its own threshold by dynamic programming on candidate counts estimated over all fingerprints, such that the
thresholds sum to radius - partitions + 1. Any pair within the radius then agrees, up to its threshold, in at
least one partition, so probing misses nothing. Candidates are verified on whole fingerprints, and each group of
candidates yields a spanning forest only.

Defined results: null or empty text has fingerprint zero and is linked like any other; repeated rows are rows of
their own; null doc_id rows get the component of their fingerprint and link others like any row (component_id is null
where no row reached has an id); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, connected_components, cut, free, id_text, sorted_runs, spool

BITS, SEED = 64, 42
NO_ID = -(1 << 63)
CELL = 512  # members of one salt of a hot bucket


def shingles(text: str, width: int) -> list[bytes]:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space x20, x09-x0D only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint: bit set if set in more than half of the shingles' XXH64."""
    parts = shingles(text, width)
    if not parts:
        return 0
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    hashed = np.fromiter((digest(s, SEED) for s in parts), np.uint64, len(parts))
    for at in range(0, len(hashed), 8192):
        total += np.unpackbits(hashed[at : at + 8192].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def bit_moments(fps: DataFrame, *columns: str) -> list[tuple[int, np.ndarray]]:
    """For each column: number of fingerprints and the 64x64 counts of bits set together, over all of them."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((len(columns), BITS, BITS), np.int64)
        for b in batches(it, 8192):
            n += b.num_rows
            for k, c in enumerate(columns):
                x = np.unpackbits(b.column(c).to_numpy().astype(">i8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
                both[k] += (x.T @ x).astype(np.int64)
        if n:
            i, j = np.triu_indices(BITS)
            for k in range(len(columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i) + 1, k, np.int32)), pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(both[k, i, j], n))], ["k", "ij", "n"])

    rows = fps.select(*columns).mapInArrow(run, "k int, ij long, n long").groupBy("k", "ij").agg(F.sum("n").alias("n")).collect()  # at most 2081 for each column
    both, n = np.zeros((len(columns), BITS, BITS)), 0
    for k, ij, c in rows:
        if ij < 0:
            n = c
        else:
            both[k, ij // BITS, ij % BITS] = both[k, ij % BITS, ij // BITS] = c
    return [(n, x) for x in both]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into equal partitions, the most correlated together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS + parts - 1 - k) // parts
        seed = min(left, key=lambda b: (abs(p[b] - 0.5), b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... most of these bits, from the bits' frequencies."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        dist[1:-1] = dist[1:-1] * (1 - d) + dist[:-2] * d
        dist[0] *= 1 - d
    return list(np.cumsum(dist[: most + 1]))


def allocate(n: int, both: np.ndarray, radius: int, key_cost: float = 40.0, most: int = 100) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds, of least estimated cost; a partition at -1 is left out.

    Cost: candidate pairs, and key_cost for each key a fingerprint emits, of which there are ``most`` at most. Exact at
    any choice. Fewer than two fingerprints have no pairs and need no partition.
    """
    if n < 2:
        return []
    p, best = np.diag(both) / n, (math.inf, [])
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        cost = []
        for g in groups:
            chance = within(p, g, radius)
            cost.append([0.0] + [n * key_cost * math.comb(len(g), t) + n * n / 2 * chance[t] * math.comb(len(g), t) ** 0.5 for t in range(radius + 1)])
        table = {0: (0.0, [])}  # sum of (threshold + 1) so far -> cost, thresholds
        for c in cost:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (v, ts) in table.items():
                for t in range(-1, radius + 1):
                    x = (v + c[t + 1], [*ts, t])
                    if s + t + 1 not in grown or x < grown[s + t + 1]:
                        grown[s + t + 1] = x
            table = grown
        v, ts = table[radius + 1]  # sum(t) = radius - parts + 1
        if v < best[0] and sum(math.comb(len(g), t) for g, t in zip(groups, ts) if t >= 0) <= most:
            best = (v, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """Signed 64-bit masks: two values within t bits of each other agree under one of C(w, t) masks."""
    from itertools import combinations

    out = []
    for bits, t in plan:
        whole = sum(1 << b for b in bits)
        for gone in combinations(bits, t):
            m = whole - sum(1 << b for b in gone)
            out.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return out


def keys_of(column: str, plan: list[tuple[list[int], int]], salt: int = 0) -> list[Column]:
    """The keys of a fingerprint: it shares one with any that is within the plan's radius."""
    return [F.xxhash64(F.col(column).bitwiseAND(F.lit(m)), F.lit(salt), F.lit(i)) for i, m in enumerate(masks(plan))]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ."""
    return np.bitwise_count(x ^ y)


def forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the fingerprints within the radius; what is reached is not compared again."""
    edges = []
    while len(fp) > 1:
        frontier, fp, rep = [(fp[0], rep[0])], fp[1:], rep[1:]
        while frontier and len(fp):
            at, who = frontier.pop()
            near = apart(fp, at) <= radius
            if near.any():
                edges.append((np.full(int(near.sum()), who), rep[near]))
                frontier += zip(fp[near], rep[near])
                fp, rep = fp[~near], rep[~near]
    return edges


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """(u, v): edges that connect the candidates within the radius. keyed: rep, fp (a fingerprint of it) and key; those
    that share a key are candidates."""
    counts = spool(keyed.groupBy("key").count().where("count > 1"))
    cells = F.ceil(F.col("count") / CELL).cast("int")
    salted = (
        keyed.join(counts, "key")
        .select("rep", "fp", "key", cells.alias("g"), F.pmod(F.xxhash64("fp"), cells).cast("int").alias("s"))
        .select("rep", "fp", "key", F.explode(F.expr("transform(sequence(0, g - 1), t -> named_struct('a', least(s, t), 'b', greatest(s, t)))")).alias("c"))
        .select("rep", "fp", F.xxhash64("key", "c.a", "c.b").alias("cell"))
    )

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in sorted_runs(it, "cell"):
            cell, rep, fp = c["cell"], c["rep"], c["fp"].view(np.uint64)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(starts, len(cell)))
            out = []
            small = np.repeat(sizes <= 6, sizes)
            for d in range(1, min(6, len(cell))):
                pair = np.flatnonzero(small[:-d] & (cell[d:] == cell[:-d]))
                pair = pair[apart(fp[pair + d], fp[pair]) <= radius]
                if len(pair):
                    out.append((rep[pair], rep[pair + d]))
            for s, k in zip(starts[sizes > 6], sizes[sizes > 6]):
                out += forest(fp[s : s + k], rep[s : s + k], radius)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["u", "v"])

    return salted.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Links are between fingerprints, so those that only rows of null doc_id have link others like any.
    """
    prints = cut(fingerprints(docs, width))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    plan = allocate(*bit_moments(reps, "fp")[0], radius)
    least = reps.select("fp", F.col("rep").alias("component_id"))
    if plan:
        found = spool(connected_components(links(reps.select(F.col("fp").alias("rep"), "fp", F.explode(F.array(*keys_of("fp", plan))).alias("key")), radius)))
        known = reps.join(found, reps["fp"] == found["node"])
        lowest = known.groupBy("component").agg(F.min("rep").alias("lowest"))
        linked = known.join(lowest, "component").select(F.col("node"), "lowest")
        least = reps.join(linked, reps["fp"] == linked["node"], "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("lowest")).alias("component_id"))
    out = prints.join(least, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicate stage: words of a wide fingerprint, bits apart in any one of them, words in a shingle, similarity, rows of a split key.
WORDS, NEAR, WIDTH, SIMILAR, MEET = 8, 3, 5, 0.8, 4096
#: Bits of a set's bitmap: the lowest bits of its hashes that occur.
MAP = 2048


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    parts = shingles(text, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts)))


def wide_print(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Independent SimHashes of a set of shingles, one for each word."""
    if not len(h):
        return np.zeros(words, np.uint64)
    total = np.zeros(words * BITS, np.int64)
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):
        x = h[at : at + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).view(np.uint64)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc, th and text of each row: its id (NO_ID if null), its text's hash and its text."""
    return id_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def wide_prints(texts: DataFrame, width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """doc, th, the hash sid of the text's set of shingles, its size n and bitmap, and the words of the fingerprint."""
    names = [f"p{k}" for k in range(words)]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            x = np.stack([wide_print(h, words) for h in sets]).view(np.int64)
            sid = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            maps = []
            for h in sets:
                bits = np.zeros(MAP, bool)
                bits[(h & np.uint64(MAP - 1)).astype(np.int64)] = True
                maps.append(np.packbits(bits).tobytes())
            n = pa.array([len(h) for h in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(sid), n, pa.array(maps, pa.binary()), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(words))], ["doc", "th", "sid", "n", "map", *names])

    return texts.mapInArrow(run, "doc long, th long, sid long, n int, map binary, " + ", ".join(f"{n} long" for n in names))


def plausible(pairs: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) that may be similar by their bitmaps, which is exact: each bit that only one set has is a shingle
    that the other lacks, so the sets share no more than the rest."""
    share = Fraction(str(similar))
    num, den = share.numerator, share.denominator

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 8192):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("x", "y"))
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            yield b.select(["u", "v"]).filter(pa.array((num + den) * most >= num * (n + m)))

    one, other = reps.select(F.col("sid").alias("u"), "n", F.col("map").alias("x")), reps.select(F.col("sid").alias("v"), F.col("n").alias("m"), F.col("map").alias("y"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u long, v long")


def star(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs those with its least and its greatest partner, which keep together what the pairs connect."""
    some = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.array(F.min("v"), F.max("v")).alias("vs"))
    return some.select("u", F.explode("vs").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, holders: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """The pairs (u, v) of sids whose sets have this Jaccard similarity or more. Texts are moved, which take less room
    than their sets of shingles, and only those of the pairs; holders: sid, and the doc and th of a row that has it."""
    share = Fraction(str(similar))
    num, den = share.numerator, share.denominator

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            like = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = shingle_set(x, width), shingle_set(y, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                like.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(like, pa.bool_()))

    wanted = pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).distinct().join(holders, "sid")
    asked = spool(texts.join(wanted, ["doc", "th"]).select("sid", "text").dropDuplicates(["sid"]))
    one, other = asked.select(F.col("sid").alias("u"), F.col("text").alias("x")), asked.select(F.col("sid").alias("v"), F.col("text").alias("y"))
    out = spool(pairs.join(one, "u").join(other, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long"))
    free(asked)
    return out


def common_shingles(texts: DataFrame, rows: int, width: int, sample: int = 8192, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts shares, sorted, and about how many texts have them. Only the order of
    shingles and the split of keys hang on it, and neither changes a result."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, width) for t in b.column("text").to_pylist()]).view(np.int64))], ["key"])

    one_in = max(1, rows // sample)
    few = texts.where(F.pmod(F.xxhash64("th", "doc"), F.lit(one_in)) == 0).select("text")
    found = few.mapInArrow(run, "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(most).collect()
    keys, n = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order] * one_in


def sharing(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, similar: float) -> DataFrame:
    """(u, v): pairs of sids of different components, among them all whose sets have this Jaccard similarity or more.

    sets: sid, component, text; a row for each sid. Prefix filter: with the shingles of all sets in one order, two such
    sets share one of their first n - ceil(similar * n) + 1, and from their first common one on have enough left. Any
    order is exact; common shingles come last, so that few sets meet. Rows of a key that is common all the same are
    dealt into salts of about MEET rows, and each two salts meet.
    """
    share = Fraction(str(similar))
    num, den = share.numerator, share.denominator
    sent = sets.sparkSession.sparkContext.broadcast(common)  # its size is bounded

    def first(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for b in batches(it, 256):
            keys, whole, sids, comps = [], [], [], []
            for text, sid, comp in zip(b.column("text").to_pylist(), b.column("sid").to_pylist(), b.column("component").to_pylist()):
                h, salts = shingle_set(text, width), None
                n = len(h)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    times = np.where(known[at] == h, often[at], 0)
                    order = np.lexsort((h, times))
                    h, salts = h[order], -(-times[order] // MEET)
                k = n - -(-num * n // den) + 1 if n else 0
                key, left = h[:k].view(np.int64), n - np.arange(k)
                if salts is not None and (salts[:k] > 1).any():
                    own, g = sid & 0x7FFFFFFF, np.maximum(salts[:k], 1)
                    row = np.repeat(np.arange(k), g)
                    t = np.arange(len(row)) - np.repeat(np.cumsum(g) - g, g)
                    s = own % g[row]
                    cell = (np.minimum(s, t) * np.int64(1_000_003) + np.maximum(s, t)).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        cell *= np.uint64(0x9E3779B97F4A7C15)
                    key, left = np.where(g[row] > 1, key[row] ^ cell.view(np.int64), key[row]), left[row]
                keys.append(key)
                whole.append(np.minimum(n, 0x7FFFFFFF) << 32 | np.minimum(left, 0x7FFFFFFF))
                sids.append(np.full(len(key), sid))
                comps.append(np.full(len(key), comp))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sids, comps, whole)], ["key", "sid", "component", "sizes"])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in sorted_runs(it, "key"):
            key, sid, comp, n, left = c["key"], c["sid"], c["component"], c["sizes"] >> 32, c["sizes"] & 0x7FFFFFFF
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            out, small = [], np.repeat(sizes <= 8, sizes)

            def keep(i, j):
                i, j = np.broadcast_arrays(i, j)
                ok = (comp[i] != comp[j]) & ((num + den) * np.minimum(left[i], left[j]) >= num * (n[i] + n[j]))
                if ok.any():
                    x, y = sid[i[ok]], sid[j[ok]]
                    out.append((np.minimum(x, y), np.maximum(x, y)))

            for d in range(1, min(8, len(key))):
                i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]))
                keep(i, i + d)
            for s, k in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
                if (comp[s : s + k] != comp[s]).any():
                    for i in range(s, s + k - 1):
                        keep(np.int64(i), np.arange(i + 1, s + k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["u", "v"])

    rows = sets.mapInArrow(first, "key long, sid long, component long, sizes long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """doc, th (as in keyed_texts), sid and component of each row: near-duplicates are linked by the pairs of texts whose
    sets of shingles (by their 64-bit hashes) have this Jaccard similarity or more, all of them and no others.

    SimHash proposes pairs first, which connects most of a large group at little cost: those within NEAR bits in any of
    WORDS fingerprints, all of which the pigeonhole plan of each word finds. A prefix filter then finds every pair
    that is not connected yet. Both kinds are linked only if their exact similarity suffices, so neither the plan nor
    the size of the table has a say in the result.
    """
    texts, names = keyed_texts(docs), [f"p{k}" for k in range(WORDS)]
    ids = spool(wide_prints(texts, width))
    reps = spool(ids.groupBy("sid").agg(F.min(F.struct("doc", "th")).alias("one"), *(F.first(c).alias(c) for c in ("n", "map", *names))))
    holders = reps.select("sid", "one.doc", "one.th")
    plans = [allocate(n, both, NEAR) for n, both in bit_moments(reps, *names)]
    keys = [F.struct(k.alias("key"), F.col(c).alias("fp")) for i, (c, plan) in enumerate(zip(names, plans)) for k in keys_of(c, plan, i)]
    if not keys:
        return ids.select("doc", "th", "sid", F.col("sid").alias("component"))
    near = spool(links(reps.select(F.col("sid").alias("rep"), F.explode(F.array(*keys)).alias("k")).select("rep", "k.*"), NEAR).distinct())
    some = spool(plausible(star(near), reps, similar))
    free(near)
    sure = verified(some, holders, texts, width, similar)
    found = spool(connected_components(sure))
    free(some)

    of = holders.join(found, holders["sid"] == found["node"], "left").select("doc", "th", "sid", F.coalesce("component", "sid").alias("component"))
    common = common_shingles(texts, ids.count(), width)
    sets = texts.join(of, ["doc", "th"]).select("sid", "component", "text")
    more = spool(sharing(sets, common, width, similar))
    del sets
    free(found)
    likely = spool(plausible(more, reps, similar))
    free(more)
    # A few pairs of each text are looked at first, as what they connect needs no more of them.
    few = spool(star(likely))
    sure = sure.unionByName(verified(few, holders, texts, width, similar))
    free(few)
    found = spool(connected_components(sure))
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    open_ = likely.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    open_ = spool(open_)
    sure = sure.unionByName(verified(open_, holders, texts, width, similar))
    last = spool(connected_components(sure))
    free(likely, open_, found, reps)
    return ids.join(last, ids["sid"] == last["node"], "left").select("doc", "th", "sid", F.coalesce("component", "sid").alias("component"))


def one_of_each(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The documents without near-duplicates of a smaller doc_id, all columns kept. A row is judged by its own text:
    another text under the same or no doc_id is another document. Of a group, the rows of its smallest doc_id (null
    after all others) and of the least set of shingles under it stay, repeated rows together."""
    groups = near_groups(docs, width, similar)
    order = F.struct((F.col("doc") == NO_ID).alias("none"), "doc", "sid")
    first = spool(groups.groupBy("component").agg(F.min(order).alias("first")))
    gone = spool(groups.join(first, "component").where(order != F.col("first")).select("doc", "th").distinct())
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    return keyed.join(gone, ["doc", "th"], "left_anti").select("row.*")
