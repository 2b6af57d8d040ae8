import random
import re

import duckdb
import numpy as np
import pytest

from lodspark.llm import licenses
from lodspark.llm.licenses import TEMPLATES, Automaton, compiled
from lodspark.llm.words import split_words


def automaton(markup):
    return Automaton("x", markup, True)


def longest(markup, text):
    return automaton(markup).longest(iter(split_words(text.encode())))


def test_regions():
    a = "one <<beginOptional>>two <<beginOptional>>three<<endOptional>> four<<endOptional>> five <<var;words=1..3>> six"
    assert longest(a, "One, five any SIX!") == 4
    assert longest(a, "one two four five a b c six seven") == 8
    assert longest(a, "one two three four five a six") == 7
    assert longest(a, "one two three five a six") == 0, "four is mandatory once two is there"
    assert longest(a, "one five six") == 0 and longest(a, "one five a b c d six") == 0
    assert longest(a, "one five six six six") == 5, "the longest wording counts"
    assert longest("a b", "a b") == 2 and longest("a b", "a") == 0 and longest("a", "a a") == 1


def test_faulty_templates():
    for bad in ("", "<<beginOptional>>a", "a <<endOptional>>", "<<var;words=0..2>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            automaton(bad)


def test_automata_equal_patterns():
    """The automaton and a backtracking pattern accept the same beginnings."""
    rng = random.Random(3)
    letters = ["a", "b", "c"]

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.25 and depth:
                out.append(f"<<beginOptional>>{some(depth - 1)}<<endOptional>>")
            elif kind < 0.4:
                low = rng.randint(0, 2)
                out.append(f"<<var;words={low}..{low + rng.randint(0, 2)}>>")
            else:
                out.append(rng.choice(letters))
        return " ".join(out)

    for _ in range(300):
        markup = "a " + some(2)
        body = licenses.pattern(markup)
        for _ in range(20):
            words = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            ends = [n for n in range(1, len(words) + 1) if re.fullmatch(body, " " + " ".join(words[:n]) + " ")]
            assert longest(markup, " ".join(words)) == max(ends, default=0), (markup, words)


def filled(markup, rng):
    """A wording of a template, with capitals and marks."""
    items, jumps = compiled(markup)
    out, k = [], 0
    while k < len(items):
        to = [b for a, b in jumps if a == k]
        if to and rng.random() < 0.5:
            k = rng.choice(to)
            continue
        out.append("Holder" if items[k] is None else items[k].decode())
        k += 1
    return rng.choice([" ", ", ", "\n", " - "]).join(w.upper() if rng.random() < 0.3 else w for w in out)


def texts(many=120):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(["lorem", "under", "the", "license", "mit", "é", "version", "2", "cc", "by", "licensed", "gnu"]) for _ in range(n))
    out = []
    for k in range(many):
        label, markup = TEMPLATES[k % len(TEMPLATES)]
        whole = filled(markup, rng)
        words = whole.split()
        broken = list(words)
        broken[rng.randrange(len(words))] = "brokenword"
        out += [f"{noise(rng.randint(0, 30))} {whole}. {noise(rng.randint(0, 30))}", " ".join(broken), whole + " " + whole]
    return out + [noise(50) for _ in range(40)] + ["", "Under the MIT License", "under the mit license under the mit license", "CC-BY-NC cc by nc", "x" * 5000]


def test_query_equals_its_sql(spark, odd_rows, tmp_path):
    rows = [r[:2] for r in odd_rows] + list(enumerate(texts(), 1000))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.ORACLE)
    told = sorted(map(str, map(tuple, out.collect())))
    assert out.columns == want.columns and told == sorted(map(str, want.fetchall()))
    assert {x for r in out.collect() for x in r.labels.split(",") if x} >= {label for label, _ in TEMPLATES}


def test_places(spark):
    text = "See below. " + "word " * 5000 + "Licensed under the Apache License, Version 2.0 (the License) and released under the MIT license"
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    rows = licenses.find_licenses(docs).collect()
    want = [("apache-2.0", True, 5002, 8), ("apache-2", False, 5005, 4), ("mit", True, 5013, 5), ("mit", False, 5014, 4), ("mit", True, 5014, 4)]
    assert [sorted(map(tuple, r.places)) for r in rows if r.doc_id] == [sorted(want)] * 2
    assert [r.places for r in rows if r.doc_id is None] == [[]]


def test_words_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(licenses, "AHEAD", 2)
    scanner = licenses.Scanner([], TEMPLATES)
    rng = random.Random(1)
    for label, markup in TEMPLATES:
        text = ("é, x " + filled(markup, rng) + " end").encode()
        first = licenses._word_starts(np.frombuffer(text, np.uint8))
        assert len(first) == len(split_words(text))
        assert label in {p[0] for p in scanner.places(text, list(range(len(first))), first)}


def test_operator_keeps_columns(odd, none):
    out = licenses.find_licenses(odd)
    assert out.columns == [c for c in odd.columns if c != "n_words"] + licenses.OUT.names
    assert out.count() == odd.count() and licenses.find_licenses(none).count() == 0
    assert licenses.find_licenses(odd, [], []).filter("size(places) > 0").count() == 0
