from collections import Counter

from lodspark.llm import langid
from lodspark.llm.common import fold_of


def test_accuracy_on_held_out_documents(odd):
    out = langid.predict(odd, langid.fit(odd.filter(fold_of(3) != 1)), ["doc_id", "lang", "text"])
    rows = [r for r in out.collect() if r.lang and r.text and len(r.text.split()) > 20 and r.doc_id < 60]
    assert rows and all(r.lang_pred == r.lang for r in rows)
    odd_ones = {r.doc_id: r for r in out.collect()}
    assert all(odd_ones[i].lang_pred == "und" and odd_ones[i].score == 0 for i in (60, 61, 62, 63))
    assert out.count() == odd.count() and all(0 <= r.score <= 1 for r in odd_ones.values())


def test_repeated_rows_do_not_hide_a_language(spark):
    rows = [(k, "das ist ein haus und ein garten", "de") for k in range(3)] * 500 + [(k, "this is the house and the garden", "en") for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    profiles = langid.fit(docs, sample=2)
    assert profiles.langs == ["de", "en"] and profiles.predict("das haus und ein garten")[0] == "de"


def test_languages_under_one_id_are_learnt(spark):
    rows = [(7, f"das ist ein haus und ein garten {k}", "es") for k in range(3000)] + [(k, "this is the house and the garden", "en") for k in range(10, 310)] + [(7, "die katze", None), (None, "le chat", "fr")]
    for only in (7, 8, 12345):
        docs = spark.createDataFrame([(only if i == 7 else i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")
        assert langid.fit(docs).langs == ["en", "es"]


def brute_grams(text):
    """n-grams as (size, letters): runs of letters between single separators, one at each end."""
    runs = "".join(c if c.isalpha() else " " for c in text).split()
    low = [tuple(c.lower()[0] for c in r) for r in runs]
    s = [None]
    for r in low:
        s += [*r, None]
    if not low:
        return Counter()
    one = [(c,) for c in s if c]
    two = [(s[k], s[k + 1]) for k in range(len(s) - 1)]
    three = [(s[k], s[k + 1], s[k + 2]) for k in range(len(s) - 2) if s[k + 1] is not None]
    return Counter([*one, *two, *three])


def test_profiles_equal_brute_force(spark):
    texts = {1: "The cat, the hat -- THE end?", 2: "\u00c9t\u00e9 d\u00e9j\u00e0 vu", 3: "cat cat", 4: "12 !!", 5: ""}
    number = lambda g: sum((0 if c is None else ord(c) + 1) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) | (1 << 42 if len(g) == 2 else 0)
    for t in texts.values():
        want = Counter({number(g): n for g, n in brute_grams(t).items()})
        assert Counter(langid.ngrams(t).tolist()) == want
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    total = sum((brute_grams(t) for t in texts.values()), Counter())
    ranked = sorted(((-n, number(g)) for g, n in total.items()))[:40]
    model = langid.fit(docs, ranks=40)
    assert {int(k): int(r) for k, r in zip(model.keys, model.table[0], strict=False)} == {k: r for r, (_, k) in enumerate(ranked)}


def test_distance_is_out_of_place():
    rows = [("a", int(k), r) for r, k in enumerate(langid._ranked(langid.ngrams("aab aab aac"), 50))]
    profiles = langid.Profiles(rows, 50)
    lang, score = profiles.predict("aab aab aac")
    assert lang == "a" and score == 1.0
    grams = langid._ranked(langid.ngrams("aac xyz"), 50)
    ranks = {k: r for _, k, r in rows}
    away = sum(abs(ranks[int(k)] - i) if int(k) in ranks else 50 for i, k in enumerate(grams))
    assert abs(profiles.predict("aac xyz")[1] - (1 - away / (50 * len(grams)))) < 1e-12


def test_stage_keeps_columns_and_clean_rows(odd, none):
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {60, 61, 62, 63} & set(ids) and set(range(60)) <= set(ids)
    assert langid.keep_identified(none).count() == 0
