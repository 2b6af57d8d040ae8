import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodspark.llm import runs


def brute(w):
    """Runs by looking at every lag and place; a stretch that a smaller lag has as well is that lag's."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in found.items())


def sequences(rng, many):
    for _ in range(many):
        words = rng.choice([1, 2, 2, 3, 5, 30])
        w = [rng.randrange(words) for _ in range(rng.randint(0, 120))]
        if len(w) > 5 and rng.random() < 0.5:
            s = rng.randrange(len(w))
            p = rng.randint(1, max(1, (len(w) - s) // 2))
            w[s:] = [w[s + (i - s) % p] for i in range(s, len(w))]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = 99
        yield w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for w in sequences(rng, 600):
        assert runs.find(np.array(w, np.int64)) == brute(w), w
    for _ in range(8):
        base = [rng.randrange(500) for _ in range(rng.randint(1, 300))]
        w = (base * 20)[: rng.randint(800, 1600)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = 1000
        w += [rng.randrange(500) for _ in range(200)] + w[:300] * 2 + w[:299]
        assert runs.find(np.array(w)) == brute(w)


def test_smallest_period_alone():
    assert runs.find(np.array([1, 2] * 20)) == [(0, 40, 2)]
    assert runs.find(np.array([1] * 11)) == [] and runs.find(np.array([1] * 12)) == [(0, 12, 1)]
    assert runs.find(np.array([*range(6)] * 2)) == [(0, 12, 6)] and runs.find(np.array([*range(7)] * 2)[:13]) == []


def test_texts_do_not_reach_into_each_other():
    texts = [b"a a a a a a a", b"a a a a a a a", b"", b"x " * 12, b" \t\n ", b"b a a a a a a a a a a a a c"]
    told = list(runs.runs_of(texts))
    assert [n for n, _, _ in told] == [7, 7, 0, 12, 0, 14]
    assert [r for _, r, _ in told] == [[], [], [], [(0, 12, 1)], [], [(1, 12, 1)]]
    assert [x for _, _, x in told] == [texts[0], texts[1], b"", b"x", b"", b"b a c"]


def test_pieces_are_all_words(monkeypatch):
    text = b" \nfirst  second\x0bthird\tfourth " * 30
    monkeypatch.setattr(runs, "PIECE", 7)
    parts = list(runs.pieces(text))
    assert len(parts) > 50 and [x for p in parts for x in p] == text.split()
    assert list(runs.runs_of([text])) == [(120, [(0, 120, 4)], b"first second third fourth")]


@pytest.mark.parametrize("period", [1, 7, 5000, 90_000])
def test_long_texts(period):
    ids = np.random.default_rng(3).integers(0, 50_000, 300_000)
    ids[1000:] = ids[1000:][np.arange(299_000) % period]
    start, length, found = max(runs.find(ids), key=lambda r: r[1])
    assert found == period and start + length == 300_000 and 298_990 < length < 299_010


def expected(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    s, m, p = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), s, m, p, None if s is None else 1000 * m // p, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, odd_rows, tmp_path):
    rows = [r[:2] for r in odd_rows if r[0] != 65] + [(i, " ".join(random.Random(i).choice(["a", "b", "é"]) for _ in range(i % 90))) for i in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = runs.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert any(r[1] for r in map(tuple, out.collect()))


def test_operator_keeps_columns(odd, none):
    out = runs.collapse_runs(odd)
    assert out.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "runs", "collapsed"]
    told = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and told[60].collapsed == "" and told[60].runs == [] and told[65].n_words == 30_000
    assert runs.collapse_runs(none).count() == 0
