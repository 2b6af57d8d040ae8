import heapq
import itertools
import zlib

import numpy as np
import pytest

from lodspark.llm import huffman, tokens
from lodspark.llm.common import scratch


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n in (2, 3, 10, 300):
        counts = rng.integers(1, 1000, n) ** 2
        heap, tick = [(int(c), i) for i, c in enumerate(counts)], itertools.count(n)
        total = 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            total += a + b
            heapq.heappush(heap, (a + b, next(tick)))
        lengths = huffman.code_lengths(counts, 30)
        assert int((lengths * counts).sum()) == total
        short = huffman.code_lengths(counts, max(2, int(np.ceil(np.log2(n)))))
        assert short.max() <= max(2, int(np.ceil(np.log2(n)))) and sum(2.0 ** -int(x) for x in short) <= 1
    assert huffman.code_lengths(np.array([0, 5, 0]), 8).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


def test_bits_round_trip():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.02, 5000), 299).astype(np.int64)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=300), 12))
    first = np.array([0, 1, 1, 700, 5000])
    raw, start, at = code.encode(ids, first)
    back = code.decode(raw, start[:-1] * 8, np.diff(first))
    assert (back == ids).all() and at[700] == start[3] * 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_words_encode_as_the_library_does(library, odd_rows):
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [t for _, t, _, _ in odd_rows if t] + ["don't I'M we'LL", "A1b2 c-d e_f", "Straße ÀÉ ß ŒUVRE Ǆ", "<|startoftext|>x", "e\u0301a \u212b \ufb01", "x..y!!! ...", "İI ΑΣ"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t.encode()), "<u2").tolist() == want, t


def test_all_latin_letters_and_marks_encode_as_the_library_does(library):
    import random

    encoder, rng = tokens.WordEncoder(tokens.tokenizer_path()), random.Random(9)
    letters = [chr(c) for c in range(0x20, 0x250) if c != 0x7F] + [chr(c) for c in range(0x20)] + list("\u0130\u0301\u212a\u2126\ufb01\u3000\u2028")
    texts = [c for c in letters] + [f"a{c}b {c}{c} x{c} {c}y" for c in letters]
    for _ in range(3000):
        marks = "".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randint(0, 4)))
        texts.append("".join(rng.choice(letters[:192]) for _ in range(rng.randint(1, 6))) + marks)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t.encode()), "<u2").tolist() == want, repr(t)


def test_one_id_is_split(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2000)
    rows = [(7, f"word {k % 50} of many words") for k in range(600)] + [(None, "same row")] * 300 + [(k, "x") for k in range(100)]
    path = scratch(spark, "t")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, block_ids=64)
    sizes = [r.n for r in spark.read.parquet(f"{path}/blocks").groupBy("shard").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()]
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)
    got = sorted(((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in tokens.read_tokens(spark, path).collect()))
    assert [r[1] for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got[:-1], got[1:], strict=True))


def test_files_give_back_all_ids(spark, odd, odd_rows, library):
    path = scratch(spark, "t")
    tokens.write_tokens(odd, path, block_ids=1000, stride=64)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_tokens(spark, path).collect()), key=lambda r: r[1])
    at = 0
    for _, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    want = sorted((i if i is not None else -1, zlib.crc32(np.array([*(library.encode(t, add_special_tokens=False).ids if t else []), 1], "<u4").tobytes())) for i, t, _, _ in odd_rows)
    assert sorted((r[0], zlib.crc32(r[3])) for r in got) == want


def test_empty(none):
    assert tokens.tokenized(none).count() == 0
