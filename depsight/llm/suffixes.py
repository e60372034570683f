"""Removal of byte strings of LENGTH or more that occur more than once, by column-wise multi-document BWT construction.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else. Anchors make the suffixes comparable in
small collections: of every SHORT-byte string, the leftmost smallest hash of its CORE-byte strings is an anchor, so
equal strings have equal anchors at equal places. Those that are smallest of a whole LENGTH-byte string too are wide.
An anchor's context is what the strings that hold it can cover: up to SIDE bytes before its core, the core, and as many
after it (NEAR for anchors that are not wide). Contexts whose core occurs once are left; equal contexts become one
with a count.

The contexts that share cores are the documents of a collection. Its Burrows-Wheeler transform is built column by
column from the right: each round inserts one symbol for every document, at the place that the previous round's order
and the symbol give, and updates the common prefixes from interval minima. As all columns are aligned at the anchors,
symbols count as tagged by their column; suffixes of different columns then never mix, and a round's insertions are
one new segment that is made from the segment before, sequentially. Suffixes at neighbouring ranks with a common
prefix of LENGTH bytes or more start repeated strings; the same prefixes show the repeated strings of SHORT bytes, of
which only passages of over WORDS words are reported and nothing is removed. Collections stream from the sorted
shuffle files in blocks of about BLOCK documents.

Groups of one core that hold more than MOST different contexts do not meet in a task: their strings are compared as
hashes of the bytes around the core, over pieces of the start places first, and start by start where pieces differ.

Defined results: null is the empty text; texts under LENGTH bytes and empty texts keep all bytes; rows of equal text
remove each other's bytes, repeated rows and equal or null ids included; self-overlapping strings count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, free, spool

LENGTH, SHORT, WORDS, CORE = 400, 256, 50, 64
SIDE, NEAR = LENGTH - CORE, SHORT - CORE  # also the largest start places of strings in a context
BLOCK, MOST, PIECE = 4096, 20000, 43
NO_ID = -(1 << 63)
_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
#: A range of start places is one number: whether its strings are long, and its first and last place, raised by LIFT.
LIFT, _HIGH, _PLACE = 1024, 1 << 31, (1 << 31) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slide(x: np.ndarray, w: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over each run of w values."""
    n = len(x) - w + 1
    y = np.full(-(-len(x) // w) * w, pad, np.uint64)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    before, after = f.accumulate(y, axis=1).ravel(), f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[:n], before[w - 1 : w - 1 + n])


def _chosen(h: np.ndarray, span: int) -> np.ndarray:
    """Which values are the smallest of any run of span values."""
    low = _slide(h, span, np.minimum, 2**64 - 1)
    around = np.zeros(len(h) + span - 1, np.uint64)
    around[span - 1 : span - 1 + len(low)] = low
    return h == _slide(around, span, np.maximum, 0)[: len(h)]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, hashes of their cores and of their contexts, and whether they are wide."""
    n = len(raw)
    if n < SHORT:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = _mixed((sums[CORE:] - sums[:-CORE]) * down[: n - CORE + 1])
    at = np.flatnonzero(_chosen(h, NEAR + 1))
    wide = _chosen(h, SIDE + 1)[at] if n >= LENGTH else np.zeros(len(at), bool)
    side = np.where(wide, SIDE, NEAR)
    start, end = np.maximum(at - side, 0), np.minimum(at + CORE + side, n)
    shape = (at - start).astype(np.uint64) * np.uint64(1009) + (end - at).astype(np.uint64) * np.uint64(2) + wide
    return at, h[at], _mixed(_mixed((sums[end] - sums[start]) * down[start]) + shape), wide


def repeats(symbols: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the lengths and each document (column of ``symbols``, row = column of the collection), whether the
    suffix at each of the first rows, up to the middle, shares that many symbols, the middle's among them, with
    another document's. Symbol 0 equals nothing."""
    rows, m = symbols.shape
    middle = rows // 2
    order, common, out = np.arange(m), np.zeros(m + 1, np.int16), [np.zeros((m, middle + 1), bool) for _ in lengths]
    for col in range(rows - 1, -1, -1):
        segment = symbols[col][order]  # the transform's symbols before the suffixes of the round before
        place = np.argsort(segment, kind="stable")  # where the new suffixes go
        sorted_ = segment[place]
        at = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 0))
        new = np.zeros(m + 1, np.int16)
        if len(at):
            a, b = place[at], place[at + 1]
            least = common[b]
            far = np.flatnonzero(b - a > 1)
            if len(far):
                ends = np.stack([a[far] + 1, b[far] + 1], axis=1).ravel()
                least[far] = np.minimum.reduceat(common, ends)[::2]
            new[at + 1] = least + 1
        order, common = order[place], new
        for length, found in zip(lengths, out):
            if middle - length < col <= middle:
                deep = common >= length
                found[order, col] = deep[:-1] | deep[1:]
    return out


def packed(long: bool, lo: np.ndarray | int, hi: np.ndarray | int):
    return (int(long) << 62) + (lo + LIFT) * _HIGH + (hi + LIFT)


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether long, first and last places."""
    return x >> 62 > 0, (x >> 31 & _PLACE) - LIFT, (x & _PLACE) - LIFT


def runs(flags: np.ndarray, long: bool) -> list[int]:
    """The runs of true, counted from the anchor."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return packed(long, np.flatnonzero(edge == 1) - SIDE, np.flatnonzero(edge == -1) - 1 - SIDE).tolist()


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [anchors(t.encode()) for t in b.column("text").to_pylist()]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                pos, a, s, wide = (np.concatenate([f[k] for f in found]) for k in range(4))
                doc, th = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("doc", "th"))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(wide)], ["doc", "th", "pos", "a", "s", "wide"])

    return texts.select("text", "doc", "th").mapInArrow(run, "doc long, th long, pos int, a long, s long, wide boolean")


def _contexts(joined: DataFrame) -> DataFrame:
    """One row for each wanted anchor: a, s, hot, and the bytes before and after the core."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 64):
            out = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    p, side = w["pos"], SIDE if w["wide"] else NEAR
                    out.append((w["a"], w["s"], w["hot"], w["wide"], raw[max(p - side, 0) : p], raw[p + CORE : p + CORE + side]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["a", "s", "hot", "wide", "lead", "tail"])

    return joined.mapInArrow(run, "a long, s long, hot boolean, wide boolean, lead binary, tail binary")


def _collections(contexts: DataFrame) -> DataFrame:
    """(a, s, x): packed runs of repeated starts (of strings of LENGTH, or of SHORT) around the anchors of each
    context, from blocks of whole collections."""

    def block(a: list, s: list, lead: list, tail: list) -> pa.RecordBatch:
        m = len(a)
        symbols = np.zeros((2 * SIDE + 1, m), np.uint16)
        for k in range(m):
            x, y = np.frombuffer(lead[k], np.uint8), np.frombuffer(tail[k], np.uint8)
            symbols[SIDE - len(x) : SIDE, k] = x
            symbols[SIDE - len(x) : SIDE, k] += 1
            symbols[SIDE + 1 : SIDE + 1 + len(y), k] = y
            symbols[SIDE + 1 : SIDE + 1 + len(y), k] += 1
        symbols[SIDE] = np.unique(np.array(a), return_inverse=True)[1] + 1
        got = [(a[k], s[k], runs(flags[k], long)) for long, flags in zip((True, False), repeats(symbols, (SIDE + 1, NEAR + 1))) for k in np.flatnonzero(flags.any(axis=1))]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["a", "s", "x"])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "s", "lead", "tail"))):
                if len(held[0]) >= BLOCK and row[0] != held[0][-1]:
                    yield block(*held)
                    held = [[], [], [], []]
                for h, v in zip(held, row):
                    h.append(v)
        if held[0]:
            yield block(*held)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, s long, x array<long>")


def _hot(contexts: DataFrame, side: int, long: bool) -> DataFrame:
    """The same for large groups and strings of one length, by hashes of the bytes around the core: pieces first, then single starts."""
    spans = -(-(side + 1) // PIECE)
    bytes_ = lambda before, after: f"substring(lead, greatest(length(lead) - ({before}), 0) + 1, {before}), least(length(lead), {before}), substring(tail, 1, {after}), least(length(tail), {after})"
    split = contexts.select("a", "s", "lead", "tail", F.expr(f"explode(sequence(0, {spans - 1}))").alias("r")).withColumns({"i0": F.col("r") * PIECE, "i1": F.least((F.col("r") + 1) * PIECE - 1, F.lit(side))})
    pieces = spool(split.select("a", "s", "i0", "i1", F.expr(f"xxhash64(a, r, {bytes_(f'{side} - i1', 'i0')})").alias("core"), F.expr(f"xxhash64(a, r, {bytes_(f'{side} - i0', 'i1')})").alias("whole")))
    wholes = spool(pieces.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("a", "s", "i0", "i1")).alias("one")))
    mixed = spool(wholes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"))
    same = pieces.join(spool(wholes.where("n > 1").select("core", "whole")), ["core", "whole"]).select("a", "s", "i0", "i1")
    starts = wholes.join(mixed, "core").select("one.*").join(contexts, ["a", "s"]).select("a", "s", "lead", "tail", F.expr("explode(sequence(i0, i1))").alias("i"))
    starts = starts.where(F.expr(f"length(lead) >= {side} - i AND length(tail) >= i")).select("a", "s", "i", F.expr(f"xxhash64(a, i, {bytes_(f'{side} - i', 'i')})").alias("h"))
    starts = spool(starts)
    often = spool(starts.groupBy("h").count().where("count > 1").select("h"))
    single = starts.join(often, "h").select("a", "s", F.col("i").alias("i0"), F.col("i").alias("i1"))
    place = f"{int(long) << 62}L + (y.i0 - {side} + {LIFT}) * {_HIGH}L + (y.i1 - {side} + {LIFT})"
    return same.unionByName(single).groupBy("a", "s").agg(F.collect_set(F.struct("i0", "i1")).alias("x")).select("a", "s", F.expr(f"transform(x, y -> {place})").alias("x"))


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(doc, th, starts): packed ranges of the places at which repeated strings start, for each text with any."""
    rows = spool(_anchor_rows(texts))
    often = spool(rows.groupBy("a").count().where("count > 1").select("a"))
    members = spool(rows.join(often, "a"))
    free(rows, often)
    kinds = spool(members.groupBy("a", "s", "wide").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "pos")).alias("one")))
    groups = spool(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    wanted = spool(kinds.join(groups, "a").select("one.doc", "one.th", F.struct("one.pos", "a", "s", "wide", (F.col("kinds") > MOST).alias("hot")).alias("w")).groupBy("doc", "th").agg(F.collect_list("w").alias("wanted")))
    contexts = spool(_contexts(texts.join(wanted, ["doc", "th"]).select("text", "wanted")))
    free(groups, wanted)
    again, far, near = kinds.where("n > 1"), packed(True, -SIDE, 0), packed(False, -NEAR, 0)
    all_starts = again.select("a", "s", F.when(F.col("wide"), F.array(F.lit(far), F.lit(near))).otherwise(F.array(F.lit(near))).alias("x"))
    part = _collections(contexts.where("NOT hot"))
    if contexts.where("hot").limit(1).count():
        large = contexts.where("hot")
        close = large.withColumns({"lead": F.expr(f"substring(lead, greatest(length(lead) - {NEAR}, 0) + 1, {NEAR})"), "tail": F.expr(f"substring(tail, 1, {NEAR})")})
        part = part.unionByName(_hot(large.where("wide"), SIDE, True)).unionByName(_hot(close, NEAR, False))
    part = spool(part)
    free(contexts)
    found = spool(all_starts.unionByName(part).select("a", "s", F.explode("x").alias("x")).groupBy("a", "s").agg(F.collect_set("x").alias("x")))
    spans = members.join(found, ["a", "s"]).select("doc", "th", F.explode(F.transform("x", lambda x: x + F.col("pos").cast("long") * (_HIGH + 1))).alias("x"))
    out = spool(spans.groupBy("doc", "th").agg(F.collect_set("x").alias("starts")))
    free(members, kinds, part, found)
    return out


def covered(lo: np.ndarray, hi: np.ndarray, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of this length that start in the given ranges."""
    lo, hi = np.maximum(lo, 0), np.minimum(hi, size - length)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    first = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return list(zip(lo[first].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist()))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, and n_passages: maximal runs covered by repeated strings of
    SHORT bytes that hold more than WORDS words, whether removed or not."""
    texts = keyed(docs)
    joined = texts.join(repeated_starts(texts), ["doc", "th"], "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, kept binary"

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            out, starts = [], b.column("starts")
            places, edges = starts.values.to_numpy(), starts.offsets.to_numpy().tolist()
            for doc_id, text, x, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), edges, edges[1:]):
                raw, gone, shared = text.encode(), [], []
                if y > x:
                    long, lo, hi = unpacked(places[x:y])
                    gone, shared = covered(lo[long], hi[long], len(raw)), covered(lo[~long], hi[~long], len(raw), SHORT)
                at, kept = 0, []
                for x, y in gone:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(y - x for x, y in gone), len(gone), sum(len(raw[x:y].split()) > WORDS for x, y in shared), b"".join(kept)))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])

    return joined.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def brute(texts: list[str]) -> list[tuple[int, int, int, str, int]]:
    """For tests: (n_bytes, n_removed, n_spans, sha256, n_passages) by counting all strings."""
    from collections import Counter

    raws = [t.encode() for t in texts]
    seen = {n: Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1)) for n in (LENGTH, SHORT)}
    out = []
    for r in raws:
        places = {n: np.array([i for i in range(len(r) - n + 1) if seen[n][r[i : i + n]] > 1], np.int64) for n in (LENGTH, SHORT)}
        gone, shared = (covered(places[n], places[n], len(r), n) for n in (LENGTH, SHORT))
        mask = np.ones(len(r), bool)
        for x, y in gone:
            mask[x:y] = False
        kept = hashlib.sha256(np.frombuffer(r, np.uint8)[mask].tobytes()).hexdigest()
        out.append((len(r), sum(y - x for x, y in gone), len(gone), kept, sum(len(r[x:y].split()) > WORDS for x, y in shared)))
    return out
