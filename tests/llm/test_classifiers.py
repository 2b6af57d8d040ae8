import math
import random

import numpy as np

from lodspark.llm import common, gam, quality, toxicity


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "on", "er", "an", "re"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 150))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if rude:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zkrumpel", "Zkrunt"]))
        if bad:
            w = [x + "$$$ ###" for x in w] if i % 2 else w[:2] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(rude)))
    docs += [(n, None), (n + 1, ""), (n + 2, "x" * 200_000), (None, "null"), (0, docs[0][1])]
    labels += [(None, 1, 1), (n + 5, 1, 0), (1, None, None), (2, labels[2][1], labels[2][2])]
    d = spark.createDataFrame([(*r, 0.1, "q", 1) for r in docs], "doc_id long, text string, score double, label string, bucket int")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, truth):
    held = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth and r.doc_id >= 300]
    return sum(held) / len(held)


def test_quality(spark, none):
    docs, labels = table(spark)
    features = quality.with_features(docs)
    out = quality.score(features, quality.fit(features, labels.filter("doc_id < 300"))).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, truth) > 0.95
    blank = quality.score(features, quality.fit(features, labels.limit(0))).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in blank)
    assert quality.with_features(none).count() == 0


def test_repeated_rows_neither_fill_the_sample_nor_outgrow_it(spark, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(39)], "doc_id long, quality int, toxic int")
    for name in ("quality", "toxic"):
        lowest = common.sample_ids(labels, name, 1, 1).collect()[0].doc_id
        many = labels.unionByName(spark.createDataFrame([(lowest, lowest % 2, lowest % 2)] * 30, labels.schema))
        assert sorted(common.sample_ids(many, name, 20, 1).collect()) == sorted(common.sample_ids(labels, name, 20, 1).collect())
        assert common.sample_ids(many, name, 20, 1).select("doc_id").distinct().count() == 20
    docs = spark.createDataFrame([(k, f"text {k} " * (k + 1)) for k in range(39)] + [(5, f"another text {k}") for k in range(5000)], "doc_id long, text string")
    fitted = []
    monkeypatch.setattr(quality.gam, "fit", lambda x, y, *a: fitted.append(len(x)))
    quality.fit(quality.with_features(docs), labels)
    monkeypatch.setattr(toxicity, "_unpacked", lambda y, bits, n, own=toxicity._unpacked: (fitted.append(len(y)), own(y, bits, n))[1])
    monkeypatch.setattr(toxicity, "LEAST", 1)
    toxicity.fit(docs, labels)
    assert fitted == [39, 39]


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (2, 0) in model.pairs
    again = rng.random((1000, 4))
    assert ((model.predict(again) > 0.5) == ((again[:, 0] > 0.5) ^ (again[:, 2] > 0.5))).mean() > 0.9
    b, c = model.bins(again, model.edges), model.bins(again, model.pair_edges)
    z = [model.constant + sum(t[b[k][i]] for k, t in enumerate(model.tables)) + sum(t[c[i1][i], c[j1][i]] for (i1, j1), t in zip(model.pairs, model.pair_tables, strict=True)) for i in range(5)]
    assert np.allclose(model.logit(again[:5]), z)


def test_toxicity(spark, none):
    docs, labels = table(spark)
    model = toxicity.fit(docs, labels.filter("doc_id < 300"))
    out = toxicity.score(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, truth) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())
    assert toxicity.score(none, model).count() == 0


def hashed(gram):
    """An n-gram's bucket: a polynomial of its lower-case characters and its size, mixed, upper bits."""
    full, h = (1 << 64) - 1, ord(gram[0]) + len(gram)
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & full
    h ^= h >> 32
    h = h * 0xFF51AFD7ED558CCD & full
    return (h ^ h >> 29) >> (64 - toxicity.BITS)


def grams_of(text):
    low = "".join(" " if c.isspace() else c.lower() if c.isupper() and len(c.lower()) == 1 else c for c in text or "")
    return {hashed(low[k : k + n]) for n in toxicity.SIZES for k in range(len(low) - n + 1)}


def test_toxicity_equals_brute_force(spark):
    docs, labels = table(spark, 60, 3)
    model = toxicity.fit(docs, labels, features=200)
    texts, marks = docs.select("doc_id", "text").collect(), [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id is not None and r.toxic is not None]
    used = sorted({(y, t.text) for i, y in marks for t in texts if t.doc_id == i}, key=repr)
    n = [sum(y == k for y, _ in used) for k in (0, 1)]
    has = [(y, grams_of(t)) for y, t in used]
    found = {}
    for y, own in has:
        for b in own:
            found.setdefault(b, [0, 0])[y] += 1
    rank = []
    for b, (other, toxic) in found.items():
        if other + toxic >= toxicity.LEAST:
            p, q, both = toxic / n[1], other / n[0], (toxic + other) / sum(n)
            rank.append((-abs(p - q) / math.sqrt(both * (1 - both) + 1e-9), b))
    best, cut = np.flatnonzero(model.place >= 0).tolist(), sorted(rank)[199][0]
    # Ranks that tie at the cut, but for their last digits, may be either.
    assert len(best) == 200 and {b for z, b in rank if z < cut - 1e-9} <= set(best) <= {b for z, b in rank if z < cut + 1e-9}
    ratio = np.array([np.log(((found[b][1] + 1) / (n[1] + 2)) / ((found[b][0] + 1) / (n[0] + 2))) for b in best])
    # The penalised loss is convex: at its least, a plain descent from the model's own weights finds nothing lower.
    x = np.array([[b in own for b in best] for _, own in has]) * ratio
    y = np.array([y for y, _ in has], float)

    def loss(w, c):
        z = x @ w + c
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.PENALTY * (w @ w) / (2 * len(y))

    w, c = model.weight / ratio, model.constant
    low = loss(w, c)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-(x @ w + c)))
        w, c = w - 0.02 * (x.T @ (p - y) / len(y) + toxicity.PENALTY * w / len(y)), c - 0.02 * (p - y).mean()
    assert low - loss(w, c) < 1e-3
    for r in toxicity.score(docs, model).collect():
        if r.doc_id is not None and r.doc_id != 0:
            own = grams_of(next(t.text for t in texts if t.doc_id == r.doc_id))
            z = model.constant + sum(v for b, v in zip(best, model.weight, strict=True) if b in own)
            assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-9
    again = toxicity.fit(docs.repartition(7, "text"), labels.repartition(3), features=200)
    assert (again.weight == model.weight).all() and again.constant == model.constant


def brute_features(text):
    """The features of one text, counted one by one."""
    raw = (text or "").encode()
    words = raw.translate(bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))).split()
    share = lambda chars: sum(b in chars for b in raw)
    n, m = max(len(raw), 1), max(len(words), 1)
    upper, lower = share(range(65, 91)), share(range(97, 123))
    top = max((words.count(w) for w in set(words)), default=0)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), upper / max(upper + lower, 1), share(range(48, 58)) / n, share(b" \t\n\r\x0b\x0c") / n, share(b".,;:?") / m, share(b"!") / m, share(b"|") / m,
        share(b"#$%&*+/<=>@\\^_`~[]{}()\"'-") / n, share(range(128, 256)) / n, share(b"\n") / m, (len(raw) - share(b" \t\n\r\x0b\x0c")) / m,
        len(set(words)) / m, top / m, sum(a == b for a, b in zip(words[1:], words[:-1])) / m, len(words) / n,
    ]


def test_quality_features_equal_brute_force(spark, odd, odd_rows, none):
    got = sorted(((str(r.doc_id), [round(v, 4) for v in r.x]) for r in quality.with_features(odd).collect()), key=repr)
    want = sorted(((str(i), [round(float(np.float32(v)), 4) for v in brute_features(t)]) for i, t, _, _ in odd_rows), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(np.allclose(g[1], w[1], atol=2e-4) for g, w in zip(got, want, strict=True))


def test_models_of_empty_tables(spark, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    features = quality.with_features(none)
    assert quality.score(features, quality.fit(features, labels)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
