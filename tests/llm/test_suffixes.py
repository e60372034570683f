import random

import numpy as np
import pytest

from depsight.llm import suffixes as S

from . import cases


def varied():
    p, q, t = cases.words(200, 1), cases.words(120, 2), list(cases.words(380, 3))
    r = random.Random(5)
    out = [None, "", "x" * 399, "x" * 400, "x" * 401, "ab" * 500, p, p, p[:300], p[5:700]]
    out += [cases.words(r.randint(0, 60), 50 + k) + p[r.randint(0, 200) : r.randint(500, len(p))] + cases.words(r.randint(0, 80), 80 + k) for k in range(10)]
    out += [cases.words(30, 200 + k) + q + cases.words(40, 300 + k) for k in range(6)]
    out += [cases.words(30, 500 + k) + p[900:1200] + cases.words(40, 600 + k) for k in range(3)] + [p[200:470], "y " * 140]
    for _ in range(5):
        x = list(t)
        for _ in range(3):
            x[r.randrange(len(x))] = "Q"
        out.append("".join(x))
    return out


@pytest.mark.parametrize("most", [20000, 1])
def test_equals_brute_force_on_either_path(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    texts = varied()
    got = sorted(tuple(r[1:]) for r in S.digest(cases.frame(spark, list(enumerate(texts)))).collect())
    assert got == sorted(S.brute([t or "" for t in texts]))


def test_edge_cases(spark):
    rows = cases.texts()
    got = sorted(tuple(r[1:]) for r in S.digest(cases.frame(spark)).collect())
    assert got == sorted(S.brute([t or "" for _, t in rows]))
    assert S.digest(cases.frame(spark, [])).count() == 0


def test_anchor_in_every_string():
    raw = cases.words(400, 9).encode()
    at, _, _, wide = S.anchors(raw)
    for i in range(len(raw) - S.SHORT + 1):
        assert ((at >= i) & (at <= i + S.NEAR)).any()
    for i in range(len(raw) - S.LENGTH + 1):
        assert (wide & (at >= i) & (at <= i + S.SIDE)).any()


def test_collection_transform_finds_shared_prefixes():
    r = np.random.default_rng(0)
    symbols = r.integers(1, 3, (21, 40)).astype(np.uint16)
    for n, got in zip((11, 8), S.repeats(symbols, (11, 8))):
        for k in range(40):
            for i in range(11 - n, 11):
                same = [(symbols[i : i + n, k] == symbols[i : i + n, j]).all() for j in range(40) if j != k]
                assert got[k, i] == any(same)
            assert not got[k, : 11 - n].any()
