import random

import pytest

from depsight.llm import simhash as S

from . import cases


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def groups(rows):
    sets, par = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    return {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))}


def docs():
    """Pairs of similarities around 0.8, a chain, a hot line, short texts and texts that repeat one line."""
    r, out = random.Random(5), []
    for k in range(60):
        ws = cases.words(100 + k, 7000 + k).split()
        cut = list(ws)
        for at in range(8, 8 + 10 * (k % 5), 10):
            cut[at] = "zz%d" % at
        out += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(cut))]
    chain = cases.words(200, 1).split()
    out += [(200 + k, " ".join(chain[4 * k : 150 + 4 * k])) for k in range(12)]
    out += [(300 + k, "all of the rights to this text are kept by us " + cases.words(4 + k, 40 + k)) for k in range(12)]
    out += [(400 + k, "one line said over again\n" * 60 + cases.words(30, 60 + k)) for k in range(4)]
    out += [(500, ""), (501, None), (502, "a b c"), (503, "A  b c"), (504, "a b c d e f g h i"), (505, "a b c d e f g h")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("proposed", [True, False])
def test_links_are_exactly_the_similar_pairs(spark, monkeypatch, proposed):
    monkeypatch.setattr(S, "MEET", 4096 if proposed else 3)  # keys are split
    if not proposed:  # what SimHash misses is found all the same
        monkeypatch.setattr(S, "links", lambda reps, *_: reps.sparkSession.createDataFrame([], "u long, v long"))
    rows = docs()
    of = [(r["doc"], r["component"]) for r in S.near_groups(cases.frame(spark, rows)).collect()]
    least = {c: min(d for d, k in of if k == c) for _, c in of}
    assert {d: least[c] for d, c in of} == groups(rows)


def test_rows_are_judged_by_their_own_text(spark):
    a, b, c, d = (cases.words(60, 900 + k) for k in range(4))
    rows = [(1, a), (None, a), (None, b), (2, c), (3, a), (3, d), (None, b), (4, b + " tail"), (5, b), (2, c)]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in S.one_of_each(cases.frame(spark, rows)).collect()))
    assert kept == sorted([(1, a), (2, c), (2, c), (3, d), (4, b + " tail")])
    assert [(r["doc_id"], r["text"]) for r in S.one_of_each(cases.frame(spark, [(None, a), (None, b)])).collect()].count((None, a)) == 1
