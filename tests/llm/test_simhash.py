import random
from collections import Counter

import numpy as np
import xxhash

from depsight.llm import simhash as S

from . import cases


def plain(text, width=3):
    ws = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())) if w]
    sh = [b" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints, radius):
    par = {i: i for i in range(len(ids))}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                par[find(i)] = find(j)
    out = []
    for i in range(len(ids)):
        same = [ids[k] for k in range(len(ids)) if find(k) == find(i) and ids[k] is not None]
        out.append((ids[i], min(same) if same else None))
    return out


def test_fingerprint_is_the_contract():
    for _, t in cases.texts():
        assert S.fingerprint(t or "") == plain(t or "")


def test_components_equal_brute_force(spark):
    base = cases.words(60, 1).split()
    r, rows = random.Random(3), []
    for k in range(60):
        ws = list(base)
        for _ in range(k % 4):
            ws[r.randrange(len(ws))] = "zz"
        rows.append((k, " ".join(ws)))
    rows += cases.texts()[:4] + [(200 + i, t) for i, (_, t) in enumerate(cases.texts())]
    got = Counter((r_["doc_id"], r_["component_id"]) for r_ in S.components(cases.frame(spark, rows)).collect())
    want = groups([i for i, _ in rows], [plain(t or "") for _, t in rows], 3)
    assert got == Counter(want)  # ids repeat with other texts


def test_large_cells_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 3)
    rows = [(k, " ".join(["same"] * 40 + [f"w{k % 9}"] * (k % 3))) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in S.components(cases.frame(spark, rows)).collect()}
    assert got == dict(groups([i for i, _ in rows], [plain(t) for _, t in rows], 3))


def test_empty_table(spark):
    assert S.components(cases.frame(spark, [])).count() == 0
    assert S.one_of_each(cases.frame(spark, [])).count() == 0


def test_rows_without_id_are_a_bridge(spark, monkeypatch):
    prints = {"a": 0, "b": 0b111, "c": 0b111111}
    monkeypatch.setattr(S, "fingerprints", lambda docs, width: docs.sparkSession.createDataFrame([(7, 0), (None, 0b111), (3, 0b111111), (None, 0xFFFF << 40)], "doc_id long, fp long"))
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in S.components(cases.frame(spark, [(1, "x")])).collect()}
    assert got == {(7, prints["a"]): 3, (None, prints["b"]): 3, (3, prints["c"]): 3, (None, 0xFFFF << 40): None}


def test_allocation_covers_all_pairs_in_the_radius():
    r = np.random.default_rng(0)
    assert S.allocate(0, np.zeros((64, 64)), 3) == S.allocate(1, np.zeros((64, 64)), 3) == []
    for n in (2, 10, 10**6, 10**10, 10**13):
        plan = S.allocate(n, (r.random((64, 64)) * 0.1 + 0.2) * n, 3)
        ms = [m & (2**64 - 1) for m in S.masks(plan)]
        assert 4 <= len(ms) <= 100
        for _ in range(300):
            flips = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(flips & m == 0 for m in ms)


def test_one_of_each_keeps_clean_and_drops_near_copies(spark):
    rows = [(k, cases.words(120, k)) for k in range(20)]
    near = []
    for k in range(20):
        ws = rows[k][1].split()
        ws[50] = "changed"
        near.append((100 + k, " ".join(ws)))
    kept = {r["doc_id"] for r in S.one_of_each(cases.frame(spark, rows + near)).collect()}
    assert kept >= set(range(20)) and len(kept & set(range(100, 120))) <= 1
