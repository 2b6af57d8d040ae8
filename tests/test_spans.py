import random

from lodspark.operators import spans

GOLDEN = [
    ("Q1", 1820, "koffie", False), ("Q1", 1821, "koffie", False), ("Q1", 1823, "koffie", False), ("Q1", 1827, "koffie", False), ("Q1", 1830, None, True), ("Q1", 1831, None, True), ("Q1", 1834, "suiker", False),
    ("Q2", 1828, None, True), ("Q2", 1829, "katoen", False), ("Q2", 1835, "katoen", False),
    ("Q3", 1840, "koffie", False), ("Q3", 1840, "suiker", True), ("Q3", 1841, None, False), ("Q3", 1842, "suiker", False), ("Q3", 1842, "koffie", False), ("Q3", 1843, "koffie", False),
    ("Q4", 1850, None, False), (None, 1850, "x", False), ("Q5", None, "x", False), ("Q4", 1851, " ", False),
]
SCHEMA = "org string, year int, product string, abandoned boolean, pos long"


def table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def status(spark, rows):
    return sorted(tuple(r) for r in spans.lifecycle_spans(table(spark, rows)).collect())


def products(spark, rows):
    return sorted(tuple(r) for r in spans.product_spans(table(spark, rows)).collect())


def test_golden(spark):
    assert status(spark, GOLDEN) == sorted(
        [("Q1", "built", 1820, None), ("Q1", "abandoned", 1830, 1831), ("Q1", "reactivated", 1834, None), ("Q2", "abandoned", 1828, None), ("Q2", "reactivated", 1829, None), ("Q2", "reactivated", 1835, None), ("Q3", "abandoned", 1840, None), ("Q3", "reactivated", 1842, None)]
    )
    assert [r for r in products(spark, GOLDEN) if r[0] != "Q3"] == [("Q1", "koffie", 1820, 1823), ("Q1", "koffie", 1827, None), ("Q1", "suiker", 1834, None), ("Q2", "katoen", 1829, None), ("Q2", "katoen", 1835, None)]
    assert [r for r in products(spark, GOLDEN) if r[0] == "Q3"] == [("Q3", "koffie", 1840, None), ("Q3", "koffie", 1843, None), ("Q3", "suiker", 1842, None)]
    assert status(spark, []) == []


def loop_status(rows):
    out = []
    for org in sorted({r[0] for r in rows}):
        state = {}
        for _, year, product, abandoned in (r for r in rows if r[0] == org):
            state[year] = max(state.get(year, 0), 2 if abandoned else 1 if product else 0)
        runs = []
        for year in sorted(y for y in state if state[y]):
            if runs and runs[-1][0] == state[year] and year - runs[-1][2] <= 2:
                runs[-1][2] = year
            else:
                runs.append([state[year], year, year])
        built = gone = False
        for s, a, b in runs:
            if s == 2:
                out.append((org, "abandoned", a, b if b != a else None))
                gone = True
            elif gone:
                out.append((org, "reactivated", a, None))
            elif not built:
                out.append((org, "built", a, None))
            built |= s == 1
    return sorted(out)


def test_random_histories_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"Q{rng.randint(1, 40)}", rng.randint(1820, 1850), rng.choice([None, "koffie", "suiker"]), rng.random() < 0.3) for _ in range(600)]
    assert status(spark, rows) == loop_status(rows)
    # Another order of rows with the places kept changes nothing.
    df = table(spark, rows)
    assert sorted(map(tuple, spans.product_spans(df.orderBy("product", "year")).collect())) == products(spark, rows)


def test_timeline_and_ranges(spark):
    s, p = spans.lifecycle_spans(table(spark, GOLDEN)), spans.product_spans(table(spark, GOLDEN))
    rows = spans.timeline(s, p).filter("org = 'Q2'").orderBy("seq").collect()
    assert [r.start_year for r in rows] == [1828, 1829, 1829, 1835, 1835]
    got = {r.org: (r.first_year, r.last_year) for r in spans.mention_range(s.select("org", "start_year", "end_year").unionByName(p.select("org", "start_year", "end_year"))).collect()}
    assert got["Q1"] == (1820, 1834)
