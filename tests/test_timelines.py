import random

from lodspark.operators import timelines


def spans(rng, n, side):
    out = []
    for k in range(n):
        f = rng.choice([None, *range(-20, 60)]) if rng.random() < 0.2 else rng.randint(-20, 60)
        u = None if rng.random() < 0.1 else (f if f is not None else 0) + rng.choice([-1, 0, 1, 2, 3, 7, 30, 64])
        out.append((rng.choice(["x", "y", "hot", "hot", "hot", None]), f"{side}{k}", f, u))
    return out


def brute(a, b):
    low, high = float("-inf"), float("inf")
    out = []
    for p, i, f, u in a:
        for q, j, g, v in b:
            f1, u1, g1, v1 = (low if f is None else f), (high if u is None else u), (low if g is None else g), (high if v is None else v)
            if p is not None and p == q and f1 < u1 and g1 < v1 and max(f1, g1) < min(u1, v1):
                out.append((p, i, j))
    return sorted(out)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    a, b = spans(rng, 80, "a"), spans(rng, 90, "b")
    left = spark.createDataFrame(a + a[:2], "place string, who string, a_from int, a_until int")
    right = spark.createDataFrame(b, "place string, what string, b_from int, b_until int")
    rows = timelines.overlaps(left, right, ["place"]).collect()
    assert sorted((r.place, r.who, r.what) for r in rows) == brute(a + a[:2], b) and rows
    known = [r for r in rows if None not in (r.a_from, r.a_until, r.b_from, r.b_until)]
    assert all((r["from"], r["until"]) == (max(r.a_from, r.b_from), min(r.a_until, r.b_until)) for r in known)
    assert timelines.overlaps(left.limit(0), right, ["place"]).count() == 0 and timelines.overlaps(left.limit(0), right.limit(0), ["place"]).count() == 0


def test_long_spans_are_few_rows(spark):
    a = spark.createDataFrame([("x", 0, 1_000_000_000), ("x", None, None)], "place string, a_from long, a_until long")
    b = spark.createDataFrame([("x", 999_999_999, None), ("x", 5, 6)], "place string, b_from long, b_until long")
    assert timelines.overlaps(a, b, ["place"]).count() == 4


def series(rows, limit, last):
    """Value of each (key, year), carried year by year."""
    best = {}
    for place, org, year, v in rows:
        if None not in (place, org, year, v):
            best[(place, org, year)] = max(best.get((place, org, year), v), v)
    out = []
    for (place, org, year), v in best.items():
        at = year
        while at <= last and at - year <= limit and (at == year or (place, org, at) not in best):
            out.append((place, org, at, v, at > year))
            at += 1
    return sorted(out)


def test_series_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.randrange(12), rng.randint(1820, 1850), rng.randint(0, 400)) for _ in range(200)]
    rows += [rows[0], (None, 1, 1830, 5), ("a", None, 1830, 5), ("a", 1, None, 5), ("a", 1, 1830, None)]
    df = spark.createDataFrame(rows, "place string, org int, year int, people long")
    for limit in (0, 3):
        want = series(rows, limit, 1850)
        got = sorted(map(tuple, timelines.carried(df, ["place", "org"], "year", "people", limit, 1850).collect()))
        assert got == want
        table = {(r.place, r.year): r for r in timelines.by_year(df, "place", ["org"], "year", "people", limit).collect()}
        low = min(r[2] for r in rows if None not in r)
        assert set(table) == {(p, y) for p in "abc" for y in range(low, 1851)}
        for (p, y), r in table.items():
            own = [x for x in want if x[0] == p and x[2] == y]
            assert (r.total, r.n_reported, r.n_carried) == (sum(x[3] for x in own), sum(not x[4] for x in own), sum(x[4] for x in own))
            assert r.change == (None if y == low else r.total - table[(p, y - 1)].total)
    assert timelines.by_year(df.limit(0), "place", ["org"], "year", "people", 2).count() == 0
