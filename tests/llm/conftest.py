"""Odd tables that every operator has to take."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, score double, words string, label string, row long, cid string, taken long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 1, "x", 0.5, "w", "l", 7, "c", 9) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    syll = {"en": ["the", "ing", "and", "er", "on", "th"], "de": ["sch", "keit", "und", "ein", "ung", "ü"], "fr": ["eau", "é", "que", "ment", "oi", "è"]}
    word = lambda g: "".join(rng.choice(syll[g]) for _ in range(rng.randint(1, 4)))
    text = lambda g, n: " ".join(word(g) for _ in range(n))
    rows = [(i, text(g, rng.randint(3, 120)) + rng.choice(["", ".", "\n"]), g, f"s{i % 3}") for i, g in enumerate(["en", "de", "fr"] * 20)]
    rows += [(60, None, "en", "s0"), (61, "", "en", "s1"), (62, " \n\t ", None, None), (63, "1234 !!", "de", None), (64, "word", "en", "s2")]
    rows += [(65, text("en", 30_000), "en", "s0"), (66, rows[0][1], "en", "s1"), (66, rows[0][1], "en", "s1"), (None, rows[3][1], None, "s2"), (None, None, None, None)]
    rows += [(67, "naïve 日本語 🎉 don't <|endoftext|> x\x1cy\u00a0z É ǅ", "en", "s0"), (68, rows[6][1] + " extra", "en", "s0"), (69, "a" * 5000, "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return docs(spark, [])
