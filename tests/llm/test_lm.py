import itertools
import json
import math
import tracemalloc
from collections import Counter

import numpy as np

from lodspark.llm import lattice, lm
from lodspark.llm.common import fold_of
from lodspark.llm.tokens import tokenizer_path


def brute(word, pieces, weights):
    index, total = {p: i for i, p in enumerate(pieces)}, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edge = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        chance = 1.0
        for a, b in itertools.pairwise(edge):
            k = index.get(word[a:b])
            chance *= math.exp(weights[(0 if a == 0 else 2) + (b == len(word))][k]) if k is not None else 0
        total += chance
    return total


def test_forward_recursion_sums_all_segmentations():
    pieces = lattice.vocabulary(tokenizer_path())
    model = lattice.Lattice(pieces, lattice.first_weights(pieces))
    words = [b"the", b"a", b"thntblere", "réeux".encode(), b"xq!!..z", b"\xff\x00", b"the"]
    got = model.run(words)
    assert np.allclose(got, [math.log(brute(w, pieces, model.weights)) for w in words])


def test_vocabulary_and_recursion_have_pieces_of_all_lengths():
    pieces = lattice.vocabulary(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        ascii_ones = {p.removesuffix("</w>").encode() for p in json.load(f)["model"]["vocab"] if p.isascii()} - {b""}
    assert {p for p in ascii_ones if p == p.lower()} <= set(pieces)
    words = [b"illustrations", b"automatically", b"qualifications", b"xautomatically"]
    assert {w.removeprefix(b"x") for w in words} <= set(pieces)
    model = lattice.Lattice(pieces, lattice.first_weights(pieces))
    assert np.allclose(model.run(words), [math.log(brute(w, pieces, model.weights)) for w in words])
    uses = np.zeros(model.weights.shape)
    model.run(words[:1], uses, np.ones(1))
    whole = math.exp(model.weights[lattice.FIRST_LAST][pieces.index(words[0])] - model.run(words[:1])[0])
    assert np.isclose(uses[lattice.FIRST_LAST][pieces.index(words[0])], whole)


def test_expected_uses_are_those_of_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc"]
    w = lattice.first_weights(pieces)
    uses = np.zeros(w.shape)
    lattice.Lattice(pieces, w).run([b"abc"], uses, np.array([2.0]))
    index, want, total = {p: i for i, p in enumerate(pieces)}, np.zeros(w.shape), 0.0
    for parts in ([b"a", b"b", b"c"], [b"ab", b"c"], [b"a", b"bc"], [b"abc"]):
        at = [(0 if k == 0 else 2) + (k == len(parts) - 1) for k in range(len(parts))]
        chance = math.exp(sum(w[a][index[p]] for a, p in zip(at, parts, strict=True)))
        total += chance
        for a, p in zip(at, parts, strict=True):
            want[a][index[p]] += 2 * chance
    assert np.allclose(uses, want / total)


def test_long_words_equal_short_ones(monkeypatch):
    pieces = lattice.vocabulary(tokenizer_path())
    model = lattice.Lattice(pieces, lattice.first_weights(pieces))
    words = [b"illustrations" * 3, "übernaïveté".encode() * 4, b"zq" * 30, b"the", b"a"]
    times = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    both = []
    for limit in (1 << 20, 0):
        monkeypatch.setattr(lattice, "LONG", limit)
        monkeypatch.setattr(lattice, "PART", 7)
        uses = np.zeros(model.weights.shape)
        both.append((model.run(words), model.run(words, uses, times), uses))
    assert np.allclose(both[0][0], both[1][0]) and np.allclose(both[0][1], both[1][1]) and np.allclose(both[0][2], both[1][2])
    monkeypatch.undo()
    word = b"longwords" * 30_000
    assert np.isfinite(model.run([word])[0])
    uses = [np.zeros(model.weights.shape) for _ in range(2)]
    model.run([word], uses[0], np.ones(1))
    monkeypatch.setattr(lattice, "PART", 1 << 20)
    model.run([word], uses[1], np.ones(1))
    sizes = np.array(list(map(len, pieces)))
    assert np.allclose(uses[0], uses[1]) and np.isclose((uses[0] * sizes).sum(), len(word)), "the pieces that are used cover the word"


def test_memory_does_not_grow_with_a_word(monkeypatch):
    pieces = lattice.vocabulary(tokenizer_path())
    model = lattice.Lattice(pieces, lattice.first_weights(pieces))
    monkeypatch.setattr(lattice, "PART", 1 << 13)
    peaks = []
    for many in (30_000, 300_000):
        word = np.random.default_rng(1).integers(97, 123, many).astype(np.uint8).tobytes()
        uses = np.zeros(model.weights.shape)
        tracemalloc.start()
        model.run([word], uses, np.ones(1))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 3_000_000 < 30_000_000, peaks


def test_words_that_no_pieces_make(monkeypatch):
    monkeypatch.setattr(lattice, "LONG", 0)
    pieces = [b"a", b"b"]
    model, uses = lattice.Lattice(pieces, lattice.first_weights(pieces)), np.zeros((4, 2))
    assert model.run([b"abc" * 20], uses, np.ones(1))[0] < -1e20 and not uses.any()


def test_whole_words_are_a_choice(odd):
    train = odd.filter(fold_of(5) != 1)
    alone = {r.doc_id: r for r in lm.score(odd, train).collect()}
    whole = {r.doc_id: r for r in lm.score(odd, train, whole_words=True).collect()}
    assert all(r.score < 0 for r in alone.values()) and alone[65].base_score == whole[65].base_score and alone[65].score < whole[65].score


def test_words_too_long_to_send_meet_their_counts(spark):
    words = [("x" * k) for k in (1, lm.COMMON_BYTES, lm.COMMON_BYTES + 1, 5000)]
    docs = spark.createDataFrame([(k, " ".join(words)) for k in (1, 1, None)], "doc_id long, text string")
    rows = lm.score(docs, docs).collect()
    assert len(rows) == 3 and {(r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(5, 5, 15)} and len({round(r.score, 9) for r in rows}) == 1


def test_chances_of_words_add_up():
    pieces = [b"a", b"b", b"ab"]
    model = lm.Chances(lattice.Lattice(pieces, lattice.first_weights(pieces)), 10, 2, 1, 0)
    seen = {b"ab": 9.0, b"b": 1.0}
    words = [bytes(x) for n in range(1, 13) for x in itertools.product(b"ab", repeat=n)]
    total = (10 ** model.of(words, np.array([seen.get(w, 0.0) for w in words]))).sum()
    assert 0.9 < total <= 1 + 1e-9


def test_base_and_score_over_odd_tables(odd, odd_rows, none):
    train = odd.filter(fold_of(5) != 1)
    out = lm.score(odd, train, common=50).collect()  # most words take the join
    plenty = lm.score(odd, train).collect()
    assert len(out) == len(odd_rows)
    key = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert key(out) == key(plenty)
    counts, ends = Counter(), 0
    for r in train.select("text").collect():
        counts.update((r.text or "").encode().lower().split())
        ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t, _, _ in odd_rows:
        own = (t or "").encode().lower().split()
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*[counts[w] for w in own], ends])
        want.append((str(i), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, round(base, 6)))
    assert [r[:5] for r in key(out)] == sorted(want)
    assert lm.score(none, none).count() == 0
    assert all(r.score < 0 for r in lm.score(odd, none).collect())
