"""SentencePiece encoding and decoding with N-best segmentation.

A text is segmented on the lattice of a public model's pieces, their scores as weights; a character without a piece
is one edge of its byte pieces, scored below every piece. Forward Viterbi scores give the best segmentation; they
are exact heuristics for a backward A* search, which yields the next best in order. Where no piece spans two adjacent
characters the lattice has a cut point, so a text is a chain of small lattices, each searched once and remembered
(runs of characters that no piece joins to others, as words and punctuation, are chunks that are remembered whole);
the N best of a text combine the N best of its chain, and only the chunks with the smallest losses can take part.

Equal scores: the longest last piece first. Alternatives are given by what differs from the best segmentation. Decoding is exact: white space is kept, unknown characters and literal
U+2581 go through byte pieces, so that every text comes back.

Defined results: null and empty texts have no ids and one segmentation of score 0; repeated rows and null ids are
rows like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import threading
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, batches, id_text

SPACE, LITERAL, N = "▁", "\ud800", 4
#: Characters of the trie's tables, and the longest chunk that is searched together with others.
LETTERS, LONG = 192, 40
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Seconds after which a worker without work forgets its lattices, as it may go on to other stages.
IDLE = 2.0
MODELS: dict[str, Lattice] = {}
_IDLE: list[threading.Timer] = []


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are decode exactly")
        self.prefix = bool(spec.add_dummy_prefix)
        self.table: dict[str, tuple[int, float] | None] = {}
        self.text, self.bytes = [], {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.text.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.text.append(p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else b"")
            if p.type in (NORMAL, USER):
                self.table[p.piece] = (i, p.score)
        scores = [v[1] for v in self.table.values()]
        self.joined = {p[k : k + 2] for p in self.table for k in range(len(p) - 1)}
        self.unknown = min((s for s in scores if s > -1e8), default=0.0) - 10
        self.longest = max(map(len, self.table), default=1)
        self.free = not any(b[1] == SPACE and b[0] != SPACE for b in self.joined)
        self.trie: dict = {}
        for p in list(self.table):
            node = self.trie
            for k, c in enumerate(p):
                child, own = node.get(c, ({}, None))
                node[c] = child, self.table[p] if k + 1 == len(p) else own
                node = child
            for k in range(1, len(p)):
                self.table.setdefault(p[:k], None)
        runs = [f"[{re.escape(''.join(g))}]+" for g in groups(b for b in self.joined if SPACE not in b)]
        self.chunks = re.compile("|".join([f"{SPACE}+(?:{'|'.join(runs)})?", *runs, "."]), re.DOTALL).findall if self.free else lambda t: [t]
        self.part = Memo(self._part, 20_000)
        self.whole = Memo(self._whole, 300_000)
        self.lists = Memo(lambda c: self._best(c, N), 10_000)
        self.plain: tuple | None = None
        self.single: set[str] | None = None

    @classmethod
    def of(cls, path: str) -> Lattice:
        """One for each worker process."""
        while _IDLE:
            _IDLE.pop().cancel()
        if path not in MODELS:
            MODELS[path] = cls(path)
        return MODELS[path]

    def rest(self) -> None:
        """The worker goes on to other work, maybe with this lattice: it keeps what it learned last for a while."""
        self.whole.old, self.part.old = {}, {}
        timer = threading.Timer(IDLE, MODELS.clear)
        timer.daemon = True
        _IDLE.append(timer)
        timer.start()

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunks((SPACE if self.prefix else "") + text.replace(SPACE, LITERAL).replace(" ", SPACE))

    def _edges(self, s: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """(start, end, ids, score), by start, longest first at each end."""
        out, get, n = [], self.table.get, len(s)
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                v = get(s[i:j], 0)
                if v == 0:
                    break
                if v is not None:
                    out.append((i, j, (v[0],), v[1]))
                    single |= j == i + 1
            if not single:
                out.append((i, i + 1, self._bytes(s[i]), self.unknown))
        return out

    def _forward(self, n: int, edges: list) -> tuple[list[float], list]:
        alpha, back = [0.0] + [-float("inf")] * n, [None] * (n + 1)
        for e in edges:
            x = alpha[e[0]] + e[3]
            if x > alpha[e[1]]:
                alpha[e[1]], back[e[1]] = x, e
        return alpha, back

    def _part(self, s: str) -> tuple[bytes, float, float]:
        """Best ids, their score and the loss of the second best, from one pass that keeps the two best at each place."""
        n, worst, trie, unknown, longest = len(s), -float("inf"), self.trie, self.unknown, self.longest
        alpha, second, came = [0.0] + [worst] * n, [worst] * (n + 1), [None] * (n + 1)
        for i in range(n):
            a, b, node, j = alpha[i], second[i], trie, i
            for c in s[i : i + longest]:
                t = node.get(c)
                if t is None:
                    break
                j += 1
                node, v = t
                if v is not None:
                    piece, score = v
                elif j == i + 1:
                    piece, score = -1, unknown
                else:
                    continue
                x = a + score
                if x > alpha[j]:
                    y = b + score
                    second[j] = y if y > alpha[j] else alpha[j]
                    alpha[j], came[j] = x, (i, piece)
                elif x > second[j]:
                    second[j] = x
            if j == i:
                x, y, j = a + unknown, b + unknown, i + 1
                if x > alpha[j]:
                    second[j] = y if y > alpha[j] else alpha[j]
                    alpha[j], came[j] = x, (i, -1)
                elif x > second[j]:
                    second[j] = x
        ids, at = [], n
        while at:
            at, piece = came[at]
            if piece < 0:
                ids += self._bytes(s[at])[::-1]
            else:
                ids.append(piece)
        return array("i", ids[::-1]).tobytes(), alpha[n], alpha[n] - second[n]

    def _grid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """The trie as tables: the child by node and letter (inner nodes first, 0 the root, -1 none), piece (-1 none) and
        score by node, and the letters, which are the LETTERS characters that most pieces hold."""
        if self.plain is None:
            often = Counter(c for p, v in self.table.items() if v is not None for c in p).most_common(LETTERS)
            letters = {ord(c): k for k, (c, _) in enumerate(often)}
            inner: list[dict] = [self.trie]
            for node in inner:
                inner += [child for c, (child, _) in node.items() if child and ord(c) in letters]
            at = {id(node): k for k, node in enumerate(inner)}
            child, leaves = np.full((len(inner), LETTERS), -1, np.int32), len(inner)
            piece, score = {}, {}
            for k, node in enumerate(inner):
                for c, (below, own) in node.items():
                    if ord(c) in letters:
                        to = at.get(id(below))
                        if to is None:
                            to, leaves = leaves, leaves + 1
                        child[k, letters[ord(c)]] = to
                        if own is not None:
                            piece[to], score[to] = own
            pieces, scores = np.full(leaves, -1, np.int32), np.zeros(leaves)
            pieces[list(piece)], scores[list(score)] = list(piece.values()), list(score.values())
            self.plain = child, pieces, scores, letters
        return self.plain

    def search(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, float, float, bytes]]]:
        """What _whole gives, for many words at a time: each step of the two-best forward pass runs over all words.
        Only words whose characters are all letters of the grid and pieces of their own."""
        child, pieces, scores, letters = self._grid()
        words = sorted(words, key=len, reverse=True)
        sizes = np.array([len(w) for w in words])
        rows, longest = len(words), int(sizes[0])
        code = np.zeros((longest, rows), np.int32)
        code.T[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(words).translate(letters).encode("utf-32-le"), "<u4")
        worst = -np.inf
        alpha, second = np.full((longest + 1, rows), worst), np.full((longest + 1, rows), worst)
        came, piece = np.zeros((longest + 1, rows), np.int32), np.zeros((longest + 1, rows), np.int32)
        alpha[0] = 0.0
        open_ = np.searchsorted(-sizes, -np.arange(longest), side="left")  # words longer than each place come first
        for i in range(longest):
            row, node = np.arange(open_[i]), np.zeros(open_[i], np.int32)
            for j in range(i + 1, min(i + self.longest, longest) + 1):
                row, node = (row, node) if len(row) <= open_[j - 1] else (row[: (k := int(np.searchsorted(row, open_[j - 1])))], node[:k])
                inner = node < len(child)
                row, node = row[inner], node[inner]
                node = child[node, code[j - 1, row]]
                live = node >= 0
                row, node = row[live], node[live]
                if not len(row):
                    break
                ends = pieces[node] >= 0
                r, n = row[ends], node[ends]
                x, y, old, old2 = alpha[i, r] + scores[n], second[i, r] + scores[n], alpha[j, r], second[j, r]
                better = x > old
                second[j, r] = np.where(better, np.maximum(y, old), np.maximum(x, old2))
                alpha[j, r] = np.where(better, x, old)
                came[j, r], piece[j, r] = np.where(better, i, came[j, r]), np.where(better, pieces[n], piece[j, r])
        ids, at, count, every = np.zeros((rows, longest), np.int32), sizes.copy(), np.zeros(rows, np.int64), np.arange(rows)
        left = every
        while len(left):
            count[left] += 1
            ids[left, longest - count[left]] = piece[at[left], left]
            at[left] = came[at[left], left]
            left = left[at[left] > 0]
        best = alpha[sizes, every]
        loss = best - second[sizes, every]
        raw, ends = ids.tobytes(), 4 * longest * np.arange(1, rows + 1)
        text = self.text.__getitem__
        for w, a, b, x, y in zip(words, (ends - 4 * count).tolist(), ends.tolist(), best.tolist(), loss.tolist()):
            own = raw[a:b]
            yield w, (own, x, y, b"".join(map(text, array("i", own))))

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Search the chunks that are not remembered yet, those of common letters together."""
        known = self.whole
        new = set().union(*texts).difference(known)
        if known.old:
            for c in new.intersection(known.old):
                known[c]  # noqa: B018  moves it over
            new.difference_update(known)
        if self.single is None:
            self.single = {c for c in map(chr, self._grid()[3]) if self.table.get(c)}
        words = [c for c in new if 1 < len(c) <= LONG and self.single.issuperset(c)]
        for at in range(0, len(words), 8192):
            known.update(self.search(words[at : at + 8192]))

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (SPACE if c == LITERAL else c).encode())

    def parts(self, chunk: str) -> list[str]:
        cuts = [0, *(k + 1 for k in range(len(chunk) - 1) if chunk[k : k + 2] not in self.joined), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:])]

    def _whole(self, chunk: str) -> tuple[bytes, float, float, bytes]:
        return self._joined([self._part(chunk)] if len(chunk) == 1 else [self.part[p] for p in self.parts(chunk)])

    def _joined(self, got: list[tuple[bytes, float, float]]) -> tuple[bytes, float, float, bytes]:
        """Ids, score, loss of the second best and decoded bytes of a chunk, from its parts."""
        ids = b"".join([g[0] for g in got])
        loss = got[0][2] if len(got) == 1 else min([g[2] for g in got])
        return ids, sum([g[1] for g in got]), loss, b"".join(map(self.text.__getitem__, array("i", ids)))

    def _astar(self, s: str, n: int) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Segmentations of s by falling score, at most n."""
        edges = self._edges(s)
        alpha, _ = self._forward(len(s), edges)
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for e in edges:
            into[e[1]].append(e)
        tick, found = count(), 0
        heap = [(-alpha[len(s)], len(s), next(tick), 0.0, None)]
        while heap and found < n:
            f, at, _, g, tail = heapq.heappop(heap)
            if at == 0:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                found += 1
                yield -f, tuple(ids)
                continue
            for i, _, ids, score in into[at]:
                heapq.heappush(heap, (-(g + score + alpha[i]), i, next(tick), g + score, (ids, tail)))

    def _best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best of a chunk, from those of its parts."""
        return merge([list(self._astar(p, n)) for p in self.parts(chunk)], n)

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        got = [self.whole[c] for c in self.split(text)]
        return np.frombuffer(b"".join([g[0] for g in got]), "<i4"), sum([g[1] for g in got])

    def nbest(self, text: str, n: int = N) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a text with their ids."""
        chunks = self.split(text)
        losses = [self.whole[c][2] for c in chunks]
        vary = set(heapq.nsmallest(n - 1, range(len(chunks)), key=lambda k: (losses[k], k)))
        return merge([self._best(c, n if k in vary else 1) for k, c in enumerate(chunks)], n)

    def ranked(self, chunks: list[str], got: list[tuple], n: int = N) -> list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]]:
        """(score, changes) of the n best: the best first, each other by the chunks whose ids differ from the best's.
        got: each chunk's best."""
        losses, lost = [g[2] for g in got], [(0.0, ())]
        least = heapq.nsmallest(n - 1, losses) if len(losses) < 16 else np.partition(losses, n - 2)[: n - 1].tolist()
        worst = max(least, default=float("inf"))
        if min(least, default=worst) < float("inf"):
            for k in [k for k, x in enumerate(losses) if x <= worst][: n - 1 + losses.count(worst)]:
                if len(lost) == n and losses[k] >= lost[-1][0]:
                    continue
                own = self.lists[chunks[k]] if n == N else self._best(chunks[k], n)
                lost = heapq.nsmallest(n, [(a + own[0][0] - s, c if ids is own[0][1] else (*c, (k, ids))) for a, c in lost for s, ids in own], key=itemgetter(0))
        best = sum([g[1] for g in got])
        return [(best - x, c) for x, c in lost]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def groups(pairs: Iterable[str]) -> list[list[str]]:
    """Characters linked by the pairs, largest group first."""
    of: dict[str, list[str]] = {}
    for a, b in pairs:
        one, two = of.setdefault(a, [a]), of.setdefault(b, [b])
        if one is not two:
            one, two = (one, two) if len(one) >= len(two) else (two, one)
            one += two
            of |= dict.fromkeys(two, one)
    return sorted({id(g): sorted(g) for g in of.values()}.values(), key=lambda g: (-len(g), g))


def merge(lists: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best joins of one choice from each list."""
    out: list[tuple[float, tuple]] = [(0.0, ())]
    for own in lists:
        if len(own) == 1:
            out = [(s + own[0][0], (*p, own[0][1])) for s, p in out]
        else:
            out = heapq.nsmallest(n, [(s + t, (*p, q)) for s, p in out for t, q in own], key=lambda x: -x[0])
    return [(s, tuple(i for q in p for i in q)) for s, p in out]


SCHEMA = "doc_id long, ids array<int>, n_tokens int, nbest_scores array<double>, alternatives array<struct<score double, edits array<struct<at int, length int, ids array<int>>>>>, decoded_crc32 long, round_trip boolean"
_EDIT = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))
NAMES = ["doc_id", "ids", "n_tokens", "nbest_scores", "alternatives", "decoded_crc32", "round_trip"]


def edited(ids: list[int], edits: Iterable[dict]) -> list[int]:
    """The ids of an alternative: those of the best with ``length`` ids from ``at`` on replaced, for each edit."""
    out, done = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += ids[done : e["at"]] + list(e["ids"])
        done = e["at"] + e["length"]
    return out + ids[done:]


def encode(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """doc_id, ids of the best segmentation, their number, the n best scores, the 2nd to nth segmentations as edits of
    the best's ids (see edited), crc32 of the decoded text, and whether all segmentations decode to the text."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model)
        whole, text_of = lattice.whole.__getitem__, lattice.text.__getitem__
        for b in batches(it, 256):
            raw, sizes, scores, others, crcs, same = [], [], [], [], [], []
            texts = b.column("text").to_pylist()
            split = list(map(lattice.split, texts))
            lattice.learn(split)
            for text, chunks in zip(texts, split):
                got = list(map(whole, chunks))
                ids = b"".join([g[0] for g in got])
                raw.append(ids)
                sizes.append(len(ids) // 4)
                ranks = lattice.ranked(chunks, got, n)
                scores.append([s for s, _ in ranks])
                begin = list(accumulate([len(g[0]) for g in got], initial=0)) if len(ranks) > 1 else []
                others.append([(s, [(begin[k] // 4, len(got[k][0]) // 4, new) for k, new in c]) for s, c in ranks[1:]])
                back = b"".join([g[3] for g in got])
                back = back[1:] if lattice.prefix and back[:1] == b" " else back
                crcs.append(zlib.crc32(back))
                same.append(back == text.encode() and all(b"".join(map(text_of, new)) == got[k][3] for _, c in ranks[1:] for k, new in c))
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(sizes, pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array(others, _OTHERS), pa.array(crcs, pa.int64()), pa.array(same)], NAMES)
        lattice.rest()

    return id_text(docs).mapInArrow(run, SCHEMA)
