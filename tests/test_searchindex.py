import random

from lodspark.operators import searchindex
from lodspark.operators.searchindex import TrigramIndex

KIND = "id long, label string, names array<string>, district string, pos long"


def brute(rows, queries):
    out = set()
    for i, label, names, district, _ in rows:
        for q in {q.strip() for q in queries if q and q.strip()}:
            if any(q.lower() in t.lower() for t in [label, district, *(names or [])] if t is not None):
                out.add((q, i))
    return out


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK_BITS", 4)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé Ü日") for _ in range(rng.randint(0, 9)))
    rows = [(i, rng.choice([None, word()]), rng.choice([None, [], [word(), word()], [None, word()]]), rng.choice([None, "Para", word()]), rng.choice([None, i])) for i in range(300)]
    rows += [(1000, "common " * 400, None, None, 5), (1001, "x", ["", "ab"], None, 5)]
    queries = [None, "", "  ", "a", "ab", "AB", "abc", "para", " Para ", "common common", "é", "日", "zzz", "abcz", "c d", "x", *[r[1][1:5] for r in rows[:40] if r[1]]]
    index = TrigramIndex(spark, str(tmp_path / "index"), ["label", "names", "district"])
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    assert index.search(asked).count() == 0
    index.append(spark.createDataFrame(rows[:200], KIND), "pos")
    assert {tuple(r) for r in index.search(asked).collect()} == brute(rows[:200], queries)
    index.append(spark.createDataFrame(rows[200:], KIND))
    index.append(spark.createDataFrame([], KIND))
    found = [tuple(r) for r in index.search(asked).collect()]
    assert set(found) == brute(rows, queries) and len(found) == len(set(found))


def test_few_buckets_and_blocks_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK_BITS", 6)
    index = TrigramIndex(spark, str(tmp_path / "index"), ["label"])
    index.append(spark.range(2000).selectExpr("id", "concat('place ', id, if(id = 777, ' needle', '')) as label", "id as pos"), "pos")
    hits = index.search(spark.createDataFrame([("needle",)], "query string"))
    assert [r.id for r in hits.collect()] == [777]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, "only the buckets and blocks that the query meets are read"
