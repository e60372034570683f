import random

import sentencepiece

from depsight.llm.pieces import Lattice, edited, encode
from depsight.llm.queries import tokenizer_path

from . import cases

MODEL = tokenizer_path("piece_bpe_32k.model")


def every(lattice, text):
    s = ("▁" + text.replace("▁", "\ud800").replace(" ", "▁")) if text else ""
    at, out = {}, []
    for e in lattice._edges(s):
        at.setdefault(e[0], []).append(e)

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
        for e in at.get(i, []):
            go(e[1], score + e[3], ids + e[2])

    go(0, 0.0, ())
    return sorted((x for x, _ in out), reverse=True)


def test_nbest_equals_enumeration():
    lattice, r = Lattice.of(MODEL), random.Random(1)
    texts = ["a  b", "the cat", "été ☃", "  x", "aaa aaa", "a▁b\n", " ", "", "in,the."]
    for t in texts + ["".join(r.choice("the inaé,.\n▁ ") for _ in range(r.randint(0, 10))) for _ in range(80)]:
        want = every(lattice, t)[:4]
        best = lattice.nbest(t)
        ids, score = lattice.encode(t)
        assert [s for s, _ in best] == want and tuple(ids.tolist()) == best[0][1]
        ranks = lattice.ranked(lattice.split(t), [lattice.whole[c] for c in lattice.split(t)])
        assert [s for s, _ in ranks] == want and score == want[0]
        assert len({i for _, i in best}) == len(best)
        assert all(lattice.decode(i) == t for _, i in best)


def test_decodes_as_the_library_does():
    lib, lattice = sentencepiece.SentencePieceProcessor(model_file=MODEL), Lattice.of(MODEL)
    for _, t in cases.texts():
        if t and "▁" not in t:
            assert lib.decode(lattice.encode(t)[0].tolist()) == t


def test_edge_cases(spark):
    rows = {r["doc_id"]: r for r in encode(cases.frame(spark), MODEL).collect()}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows.values())
    assert rows[1]["ids"] == [] and rows[2]["nbest_scores"] == [0.0] and rows[2]["alternatives"] == []
    assert encode(cases.frame(spark, []), MODEL).count() == 0


def test_no_piece_spans_two_chunks():
    lattice, r = Lattice.of(MODEL), random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("the inéß,.$-\r\n▁ 0☃данж一个─") for _ in range(r.randint(1, 40)))
        chunks = lattice.split(t)
        assert "".join(chunks) == t.replace("▁", "\ud800").replace(" ", "▁") if not lattice.prefix else "".join(chunks)[1:] == t.replace("▁", "\ud800").replace(" ", "▁")
        assert all(a[-1] + b[0] not in lattice.joined for a, b in zip(chunks, chunks[1:]))


def test_search_of_many_words_equals_single_words():
    lattice, r = Lattice(MODEL), random.Random(4)
    words = {"".join(r.choice(r.choice(["the inaoérst", "aeinrst", "▁ab", "zq#x", "☃é日a"])) for _ in range(r.randint(2, 44))).replace(" ", "▁") for _ in range(4000)}
    plain = Lattice(MODEL)
    lattice.learn([list(words), [], ["▁the"]])
    assert len(lattice.whole) > 500  # those of common letters took the common way
    assert {c: lattice.whole[c] for c in words} == {c: plain._whole(c) for c in words}
    lattice.learn([list(words)])


def test_alternatives_are_the_next_best_segmentations(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("the inaé,.\n▁ ☃") for _ in range(r.randint(0, 9))) for _ in range(40)]
    lattice = Lattice.of(MODEL)
    for row in encode(cases.frame(spark, list(enumerate(texts))), MODEL).collect():
        t, ids = texts[row["doc_id"]], list(row["ids"])
        made = [tuple(ids)] + [tuple(edited(ids, [e.asDict() for e in a["edits"]])) for a in row["alternatives"]]
        assert row["nbest_scores"] == every(lattice, t)[:4] and [a["score"] for a in row["alternatives"]] == row["nbest_scores"][1:]
        assert len(set(made)) == len(made) and all(lattice.decode(m) == t for m in made) and row["round_trip"]
