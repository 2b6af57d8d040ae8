import re

from pyspark.sql import functions as F

from lodspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: cap * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_targets_and_budgets(odd, odd_rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in odd_rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = brute_targets(sizes)
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - goal[s]) < 1e-6
        assert sum(r.taken for r in own) == round(goal[s])
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))


def test_small_source_stops_at_its_cap(spark):
    rows = [(1, "a b", "a"), *[(i, "x y z " * 10, "b") for i in range(2, 20)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert out[1].taken == 6 and out[1].target == 6.0
    assert sum(r.taken for r in out.values()) == 2 + 18 * 30


def test_rows_without_id_and_equal_rows_are_dealt(spark):
    rows = [(None, f"word {k}", "a") for k in range(3000)] + [(7, f"word word {k}", "a") for k in range(3000)] + [(8, "same text here", "a")] * 4000 + [(None, "w " * 5, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16)
    plan = mixing._plan(df)
    parts = plan.withColumn("part", F.substring("key", 1, 3)).groupBy("part", "doc_id").count().collect()
    assert len({r.part for r in parts if r.doc_id is None}) > 1500 and len({r.part for r in parts if r.doc_id == 7}) > 1500
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    want = brute_targets({"a": 3000 * 2 + 3000 * 3 + 4000 * 3, None: 250})
    for s in ("a", None):
        assert sum(r.taken for r in out if r.source == s) == round(want[s])
    same = sorted(r.taken for r in out if r.doc_id == 8)
    assert len(same) == 4000 and sum(0 < x % 3 for x in same) <= 1, "at most one row is cut"
    again = mixing.mix(df.repartition(5, "text")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_stage_repeats_documents(odd, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 * 2  # doc 66 is there twice
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_stage_takes_what_the_mix_takes(spark):
    rows = [(i, "w " * (i % 13), "abcde"[i % 5] if i % 7 else None) for i in range(700)] + [(None, "q " * k, "a") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r.doc_id, r.source, r.size): -(-r.taken // r.size) for r in mixing.mix(df).collect() if r.taken}
    got = {(r.doc_id, r.source, len(r.text.split())): r["count"] for r in mixing.mixed(df).groupBy("doc_id", "source", "text").count().collect()}
    assert got == want
