import math
import random
import zlib

import numpy as np

from depsight.llm import quality, toxicity
from depsight.llm.labelled import fold_of

from . import cases


def corpus(n=360, seed=1):
    r, rows, labels = random.Random(seed), [], []
    for k in range(n):
        ws = cases.words(r.randint(8, 60), 1000 + k).split()
        bad, toxic = k % 5 == 0, k % 4 == 0
        if toxic:
            for _ in range(2):
                ws.insert(r.randrange(len(ws)), r.choice(["idiot", "grotk", "grotka", "grotki", "grotku", "grotke", "blemish"]))
        if bad:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((k, " ".join(ws)))
        labels.append((k, 0 if bad else 1, int(toxic)))
    return rows, labels


def auc(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_quality_held_out(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(cases.frame(spark, rows + [(None, None), (9000, "")]), lab).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    y = {i: q for i, q, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in y]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert auc([y[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95
    kept = quality.kept(cases.frame(spark, rows), lab)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"] and r["doc_id"] in y}


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.classify(cases.frame(spark, rows + [(None, None), (9000, "")]), lab).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    y = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in y]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert auc([y[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - q if fold_of(i, 5) == 0 else q, t if fold_of(i, 3) != 1 else 1 - t) for i, q, t in labels]
    for f in (quality.classify, toxicity.classify):
        a, b = (sorted((r["doc_id"], r["score"]) for r in f(cases.frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
        assert a == b


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(cases.frame(spark), none).collect()} == {0.5}
    assert toxicity.classify(cases.frame(spark), none).count() == len(cases.texts())
    assert quality.classify(cases.frame(spark, []), none).count() == 0
    assert toxicity.classify(cases.frame(spark, []), none).count() == 0


def test_label_model_finds_rates_and_ties_copies():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.3
    acc = [(0.8, 0.05), (0.7, 0.1), (0.6, 0.1)]
    v = np.stack([r.random(len(y)) < np.where(y, a, b) for a, b in acc], axis=1)
    v = np.concatenate([v, v[:, :1]], axis=1).astype(float)  # the last voter copies the first
    bits, counts = np.unique(v, axis=0, return_counts=True)
    model = toxicity.LabelModel(4)
    start = np.where(bits.sum(1) > 0, 0.7, 0.05)
    model.fit(bits, counts.astype(float), start)
    model.tie(bits, counts.astype(float))
    assert sorted(model.cliques) == [[0, 3], [1], [2]]
    model.fit(bits, counts.astype(float), start)
    assert abs(model.rates[1, 0] - 0.7) < 0.12 and abs(model.prior - 0.3) < 0.1


def plain_em(bits, counts, post, rounds):
    """The same model in plain loops, all voters independent."""
    voters = len(bits[0])
    for _ in range(rounds):
        w1, w0 = [c * p for c, p in zip(counts, post)], [c * (1 - p) for c, p in zip(counts, post)]
        prior = (sum(w1) + 1) / (sum(counts) + 2)
        new = []
        for row in bits:
            odds = math.log(prior / (1 - prior))
            for j in range(voters):
                a = (sum(w for w, r in zip(w1, bits) if r[j] == row[j]) + 0.1) / (sum(w1) + 0.2)
                b = (sum(w for w, r in zip(w0, bits) if r[j] == row[j]) + 0.1) / (sum(w0) + 0.2)
                odds += math.log(a / b)
            new.append(1 / (1 + math.exp(-odds)))
        post = new
    return post


def test_em_equals_plain_loops():
    r = np.random.default_rng(2)
    bits, counts = np.unique(r.random((300, 4)) < np.where(r.random((300, 1)) < 0.4, 0.7, 0.1), axis=0, return_counts=True)
    bits, start = bits.astype(float), np.where(bits.sum(1) > 0, 0.7, 0.05)
    post = toxicity.LabelModel(4).fit(bits, counts.astype(float), start, rounds=7)
    assert np.allclose(post, plain_em(bits.tolist(), counts.tolist(), start.tolist(), 7), atol=1e-9)


def plain_sgd(rows, seed):
    """The embeddings' training in plain loops."""
    q = quality
    rng = np.random.default_rng(seed)
    made = []
    for text, y in rows:
        c, weights = q.counted(text), {}
        for w, n in c.items():
            own = q.features(w)
            for i in own:
                weights[i] = weights.get(i, 0.0) + n / sum(c.values()) / len(own)
        made.append((weights, y))
    vectors = rng.uniform(-1 / q.DIM, 1 / q.DIM, (q.BUCKETS, q.DIM)).astype(np.float32).astype(float)
    out, bias, done = [[0.0, 0.0] for _ in range(q.DIM)], [0.0, 0.0], 0
    for _ in range(q.EPOCHS):
        for k in rng.permutation(len(made)):
            weights, y = made[k]
            rate = q.RATE * (1 - done / (q.EPOCHS * len(made)))
            done += 1
            hidden = [sum(w * vectors[i][d] for i, w in weights.items()) for d in range(q.DIM)]
            logit = [sum(hidden[d] * out[d][c] for d in range(q.DIM)) + bias[c] for c in (0, 1)]
            top = [math.exp(x - max(logit)) for x in logit]
            err = [t / sum(top) - g for t, g in zip(top, (1 - y, y))]
            back = [sum(out[d][c] * err[c] for c in (0, 1)) for d in range(q.DIM)]
            for d in range(q.DIM):
                for c in (0, 1):
                    out[d][c] -= 0.1 * rate * hidden[d] * err[c]
            bias = [b - 0.01 * rate * e for b, e in zip(bias, err)]
            norm = max(sum(w * w for w in weights.values()), 1e-3)
            for i, w in weights.items():
                for d in range(q.DIM):
                    vectors[i][d] -= rate * w / norm * 0.1 * back[d]
    table = [sum(v[d] * (out[d][1] - out[d][0]) for d in range(q.DIM)) for v in vectors]
    return table, bias[1] - bias[0]


def test_sgd_equals_plain_loops(monkeypatch):
    for name, v in (("BUCKETS", 64), ("DIM", 3), ("EPOCHS", 2)):
        monkeypatch.setattr(quality, name, v)
    rows = [(t, float(q)) for (_, t), (_, q, _) in zip(*corpus(40))]
    model = quality.Subwords.learn(rows, seed=3)
    table, bias = plain_sgd(rows, 3)
    assert np.allclose(model.table, table, atol=2e-4) and abs(model.bias - bias) < 2e-4
    score = model.scorer()
    for text, _ in rows[:5]:
        words = text.split()
        again = sum(a == b for a, b in zip(words, words[1:]))
        each = [sum(table[i] for i in quality.features(w)) / len(quality.features(w)) for w in words]
        z = (sum(each) + again * table[0]) / (len(words) + again) + bias
        assert abs(score(text) - 1 / (1 + math.exp(-z))) < 1e-3


def test_linear_equals_its_weights():
    rows, labels = corpus(200)
    known = [(t, float(x)) for (_, t), (_, _, x) in zip(rows, labels)]
    model = toxicity.Linear.learn(known)
    score = model.scorer()
    for text, _ in known[:20]:
        z = model.bias + sum(model.weights.get(k, 0.0) * (1 + math.log(n)) for k, n in toxicity.keys(text).items())
        assert abs(score(text) - 1 / (1 + math.exp(-z))) < 1e-9
