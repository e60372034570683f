from collections import Counter

from depsight.llm import decontaminate as D

from . import cases


def brute(docs, items, similar=D.SIMILAR):
    """(doc, item, best similarity) over windows of the item's size, by plain shingles."""
    out = {}
    for d, text in docs:
        ws = D.WORDS((text or "").lower())
        for i, item in set(items):
            wi = D.WORDS((item or "").lower())
            if i is None or not wi or not ws:
                continue
            width = min(D.WIDTH, len(wi))
            sh = lambda w: Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))  # noqa: E731, B023
            b = sh(wi)
            best = 0
            for s in range(max(1, len(ws) - len(wi) + 1)):
                a = sh(ws[s : s + len(wi)])
                if a:
                    both = sum((a & b).values())
                    best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= similar:
                out[d, i] = round(best, 9)
    return out


def test_equals_brute_force(spark):
    items = [(k, cases.words(20 + 3 * k, 500 + k)) for k in range(8)] + [(50, "two words"), (51, None), (None, "x"), (52, ""), (0, cases.words(20, 500))]
    docs = cases.texts()
    for k in range(8):
        ws = items[k][1].split()
        docs.append((100 + k, cases.words(15, k) + " " + items[k][1].replace("a", "A") + " " + cases.words(9, k + 30)))
        ws[0] = "other"
        docs.append((200 + k, cases.words(4, k) + " " + " ".join(ws) + " tail"))
        docs.append((300 + k, " ".join(ws[1:])))
        ws[len(ws) // 2] = "broken"
        docs.append((400 + k, " ".join(ws)))
    docs.append((500, "see two words here"))
    frame = cases.frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.matches(frame, bench).collect():
        key = r["doc_id"], r["item_id"]
        got[key] = max(got.get(key, 0), round(r["similarity"], 9))
    want = brute(docs, items)
    assert got == want
    assert {100, 107, 200, 500} <= {d for d, _ in got}
    hit = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in D.clean(frame, bench).collect()) == sorted(str(d) for d, _ in docs if d not in hit)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(cases.frame(spark), none).count() == 0
    assert D.clean(cases.frame(spark), none).count() == len(cases.texts())
    assert D.matches(cases.frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 10)
    items = spark.createDataFrame([(k, cases.words(20, k)) for k in range(3)], "item_id long, text string")
    docs = cases.frame(spark, [(k, cases.words(20, k)) for k in range(5)])
    assert sorted((r["doc_id"], r["item_id"]) for r in D.matches(docs, items).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(r["doc_id"] for r in D.clean(docs, items).collect()) == [3, 4]
