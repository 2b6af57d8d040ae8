import re

from lodspark.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            own = words(text)
            n = min(size, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_hits_equal_brute_force(spark, odd, odd_rows):
    long = next(t for i, t, _, _ in odd_rows if i == 65)
    passage = " ".join(long.split()[100:130])
    items = [(1, passage.upper().replace(" ", "! ")), (2, "word"), (3, None), (4, "..."), (None, " ".join(long.split()[5000:5012])), (5, "日本語 🎉")]
    rows = [r for r in odd_rows if r[0] not in (65,)] + [(70, f"zz {passage} yy {passage}", "en", "s0"), (71, " ".join(long.split()[90:140]), "en", "s0")]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 25, 1):  # one block, and one for each item
        got = decontam.find(df, bench, block_bytes=block).collect()
        mine = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), list(r["items"])) for r in got), key=str)
        assert mine == brute([(i, t) for i, t, _, _ in rows], items)


def test_removal(spark, odd, none):
    bench = spark.createDataFrame([(1, "clean words then the leaked passage of ten whole words here end")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Before clean WORDS then the, leaked passage of ten whole words here END after", 9), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    assert [r.doc_id for r in decontam.decontaminate(df, bench).orderBy("doc_id").collect()] == [2, 3]
    cut = {r.doc_id: r for r in decontam.decontaminate(df, bench, "spans").collect()}
    assert cut[1].text == "Before after" and cut[1].n_chars == 12 and cut[2].text == "clean" and cut[3].text is None
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.find(none, bench).count() == 0 and decontam.find(odd, bench.limit(0)).filter("size(items) > 0").count() == 0
