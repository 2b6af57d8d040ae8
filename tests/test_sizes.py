"""What shows only in larger tables."""

import random

import duckdb

import __spark_entry__ as driver
from lodspark.operators import detail, streets


def test_near_counts_distances_as_they_are_written(spark):
    degree = 111.19492664455873
    points = spark.createDataFrame([(k, km / degree, 10.0) for k, km in enumerate([39.9, 40.0003, 40.0007, -40.0004])], "id int, lat double, lng double")
    around = spark.createDataFrame([("a", 0.0, 10.0)], "name string, lat double, lng double")
    assert sorted((r.id, r.km) for r in detail.near(points, around, 40.0).collect()) == [(0, 39.9), (1, 40.0), (3, 40.0)]


def test_new_streets_keep_all_digits_of_their_number(spark):
    places = spark.createDataFrame([("stm-99998", "Old Road", "road", None, None, None, None, ["x"])], "id string, label string, type string, lat double, lng double, wkt string, fid int, sources array<string>")
    line = [[(0.0, 0.0), (1.0, 1.0)]]
    features = spark.createDataFrame([(k, f"New Road {k}", k, line) for k in range(3)], "pos long, name string, id long, segments array<array<struct<x:double,y:double>>>")
    planned = streets.plan(streets.aggregate(features), places, "map-1916")
    assert sorted(r.id for r in streets.apply(planned, places, "map-1916").collect()) == ["stm-100000", "stm-100001", "stm-99998", "stm-99999"]


def test_place_ids_of_six_digits(spark, tmp_path):
    pages = [(k, f"https://x.example/a/{k}?q=1") for k in (7, 99999, 100000, 123456, 1234567)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = driver.queries()["place_id_from_uri"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(driver.oracle_sql()["place_id_from_uri"]).fetchall()
    assert sorted((r.page_id, r.place_id, r.same, r.tail) for r in got) == sorted(want)


def test_names_of_a_link_that_many_share_are_one_before_records_meet_them(spark):
    names = spark.createDataFrame([("s1", "name/1", f"text {k}", f"n{k}", k) for k in range(50)], "identifies string, uri string, text string, carried_by string, pos long")
    records = spark.createDataFrame([(k, "s1") for k in range(40)], "id long, a string")
    sources = spark.createDataFrame([("n49", "label")], "uri string, label string")
    got = detail.gathered(records, "id", ["a"], names, sources)
    assert sorted(tuple(r) for r in got.collect()) == [(k, "name/1", "text 49", "label") for k in range(40)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [identifies" in plan[plan.index("Join Inner, (identifies") :]


def test_close_names_with_a_long_common_beginning(spark, monkeypatch):
    from test_linkage import edits

    from lodspark.operators import registers

    rng = random.Random(3)
    names = sorted({"customer " + "".join(rng.choice("0123") for _ in range(rng.randint(0, 6))) for _ in range(250)} | {"customer", "customer 1 and a longer name than that"[:rng.randint(14, 19)]})
    names = [n for n in names if n == n.strip()]
    rows = [(k, f"n{k % 2}", n) for k, n in enumerate(names)]
    people = spark.createDataFrame(rows, "id long, nation string, name string")
    want = sorted((i, j, edits(x, y)) for i, p, x in rows for j, q, y in rows if p == q and edits(x, y) <= 2)
    for short in (12, 0):
        monkeypatch.setattr(registers, "SHORT", short)
        assert sorted(tuple(r) for r in registers.linked_persons(people, people, ["nation"], "name").collect()) == want


def test_patterns_are_counted_without_their_pairs(spark, tmp_path, monkeypatch):
    import test_linkage as t

    from lodspark.operators import linkage

    a, b = t.two_sources(150)
    a += [(900, a[0][1], *a[0][2:]), (901, None, "", None, None), (902, a[1][1], None, 1800, "P3"), (903, None, "north", 1801, "P4")]
    (ca, _), (cb, _) = (linkage.classes(spark.createDataFrame(x, t.KIND), t.FIELDS) for x in (a, b))
    want = dict(t.brute_patterns(a, b))
    monkeypatch.setattr(linkage, "compared", None)
    assert linkage.counted(ca, cb, t.FIELDS, t.BLOCKS, str(tmp_path / "w")) == want


def test_only_likely_patterns_are_compared(spark):
    import test_linkage as t

    from lodspark.operators import linkage

    a, b = t.two_sources(150)
    (ca, _), (cb, _) = (linkage.classes(spark.createDataFrame(x, t.KIND), t.FIELDS) for x in (a, b))
    wanted = ["2222", "1222", "22-2", "202-", "1202"]
    all_, some = (linkage.compared(ca, cb, t.FIELDS, t.BLOCKS, *w).collect() for w in ([], [wanted]))
    assert sorted(r for r in all_ if r.pattern in wanted) == sorted(r for r in some if r.pattern in wanted) and len(some) < len(all_)
    assert not linkage.compared(ca, cb, t.FIELDS, t.BLOCKS, []).collect()


def linked_classes(spark, a, b, weights):
    """What `links` finds and what taking the heaviest pair first finds, as classes and their numbers of persons."""
    from collections import Counter

    import test_linkage as t

    from lodspark.operators import linkage

    of, sides = [], []
    for rows in (a, b):
        classes, members = linkage.classes(spark.createDataFrame(rows, t.KIND), t.FIELDS)
        of.append({r.id: r["class"] for r in members.collect()})
        sides.append(classes.collect())
    pairs = []
    for x in sides[0]:
        for y in sides[1]:
            one = [(0, x.name, x.ward, x.born, x.psur)], [(0, y.name, y.ward, y.born, y.psur)]
            for p in t.brute_patterns(*one):
                if linkage.enough(p, t.FIELDS) and weights.chance(p) >= 0.5:
                    pairs.append((weights.weight(p), x["class"], y["class"]))
    want = t.greedy(pairs, *({r["class"]: r.n for r in s} for s in sides))
    rows = linkage.links(*(spark.createDataFrame(r, t.KIND) for r in (a, b)), t.FIELDS, t.BLOCKS, weights=weights).collect()
    assert len({r.id_a for r in rows}) == len(rows) == len({r.id_b for r in rows})
    return Counter((of[0][r.id_a], of[1][r.id_b]) for r in rows), {k: n for k, (n, _, _) in want.items()}, len(pairs)


def test_links_of_a_large_block_are_found_without_its_pairs(spark, monkeypatch):
    from lodspark.operators import linkage

    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    a = [(k, name(), "north", 1800, f"P{k % 7}") for k in range(60)]
    b = [(1000 + k, a[k][1] if k % 4 == 0 else "x" + a[k][1][1:] if k % 4 == 1 else name(), "north", 1800, f"P{k % 5}") for k in range(55)]
    even, near = {"0": 0.5, "2": 0.5}, {"0": 0.05, "2": 0.95}
    weights = linkage.Weights(0.3, [{"0": 0.9, "1": 0.05, "2": 0.05}, near, near, even], [{"0": 0.6, "1": 0.2, "2": 0.2}, {"0": 0.9, "2": 0.1}, {"0": 0.9, "2": 0.1}, even])
    rows, write = [], linkage.written

    def counted(table, path):
        out = write(table, path)
        rows.append(out.count())
        return out

    monkeypatch.setattr(linkage, "written", counted)
    got, want, pairs = linked_classes(spark, a, b, weights)
    assert got == want and len(got) == 55 and pairs == 3300
    assert max(rows) < 300


def test_links_of_one_weight_in_several_blocks_and_with_missing_values(spark):
    from lodspark.operators import linkage

    rng = random.Random(8)
    some = lambda of, p: rng.choice(of) if rng.random() < p else None
    kind = lambda k: (k, some(["anna", "annas", "bob", "bobby", "carl"], 0.9), some(["north", "south"], 1), some([1800, 1801], 0.8), some(["P1", "P2"], 1))
    a, b = [kind(k) for k in range(60)], [kind(1000 + k) for k in range(50)]
    even, near = {"0": 0.5, "2": 0.5}, {"0": 0.1, "2": 0.9}
    weights = linkage.Weights(0.5, [{"0": 0.2, "1": 0.4, "2": 0.4}, near, even, even], [{"0": 0.8, "1": 0.1, "2": 0.1}, {"0": 0.8, "2": 0.2}, even, even])
    got, want, _ = linked_classes(spark, a, b, weights)
    assert got == want and len(got) > 10


def test_points_and_polygons_meet_in_many_tasks(spark, monkeypatch):
    import test_polygons as t
    from pyspark.sql import functions as F

    from lodspark.operators import polygons

    rng = random.Random(4)
    of = t.shapes(rng)
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(300)]
    df = spark.createDataFrame(points, "p long, x double, y double").coalesce(1)
    shape = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in of.items()], f"s long, {t.RINGS}").coalesce(1)
    shape = shape.select("s", polygons.edges(F.col("rings")).alias("edges"))
    want = sorted((p, s) for p, x, y in points for s, rings in of.items() if s != 22 and t.cast(rings, x, y))
    for few in (8, 2, 0):
        monkeypatch.setattr(polygons, "FEW", few)
        got = polygons.located(df, shape, 0.5).select("p", "s", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.p, r.s) for r in got) == want, few
        assert len({r.task for r in got}) > 1


def test_spans_of_a_key_are_cut_only_where_they_are_many(spark, monkeypatch):
    import test_timelines as t

    from lodspark.operators import timelines

    rng = random.Random(5)
    a, b = t.spans(rng, 80, "a"), t.spans(rng, 90, "b")
    left = spark.createDataFrame(a, "place string, who string, a_from int, a_until int")
    right = spark.createDataFrame(b, "place string, what string, b_from int, b_until int")
    few = sum(p in ("x", "y") for p, *_ in a) // 2 + 5
    for dense, cut in ((512, False), (few, True), (0, True)):
        monkeypatch.setattr(timelines, "DENSE", dense)
        met = timelines.overlaps(left, right, ["place"])
        assert sorted((r.place, r.who, r.what) for r in met.collect()) == t.brute(a, b)
        assert ("block" in met._jdf.queryExecution().optimizedPlan().toString()) == cut


def test_the_map_needs_no_almanac_and_files_are_many(spark, tmp_path, monkeypatch):
    from lodspark.plans import archive

    monkeypatch.setattr(archive, "almanac", None)
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = con.sql(driver.oracle_sql()["archive_map"]).fetchall()
    assert sorted(map(tuple, archive.QUERIES["archive_map"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)
    path = archive._csv(spark.range(100).coalesce(1), str(tmp_path / "rows.csv"))
    assert len(spark.read.csv(path, header=True).select("_metadata.file_name").distinct().collect()) > 1


def test_single_entities_are_rewritten_in_their_row(spark, tmp_path, monkeypatch):
    from lodspark.operators import jsonld

    once = [
        ("a", "E13", '{"year":"1850","deserted":true,"size":12,"name":"x \\"y\\""}'), ("b", "E25", '{"identified_by":["n2","n1","n2",null],"depicted_on":["m"],"label":null,"own":[]}'), ("c", "E25", "{}"), ("d", "E25", None),
    ]
    twice = [("e", "E41", '{"identifies":"p"}'), ("e", "E41", '{"identifies":"q"}'), ("f", "E25", '{"label":"l","prefLabel":"k"}')]
    want = [
        ("a", "E13", '{"deserted":true,"observationYear":"1850","observedName":"x \\"y\\"","sizeAkkers":12}'), ("b", "E25", '{"P138i_has_representation":"m","P1_is_identified_by":["n2","n1"]}'),
        ("e", "E41", '{"P1i_identifies":["p","q"]}'), ("f", "E25", '{"prefLabel":["k","l"]}'),
    ]
    g = spark.createDataFrame(once + twice, "id string, class string, body string")
    assert sorted(map(tuple, jsonld.documents(g).collect())) == want
    taken = []
    bodies = jsonld._bodies
    monkeypatch.setattr(jsonld, "_bodies", lambda rows: taken.append({r.id.id for r in rows.collect()}) or bodies(rows))
    assert sorted(map(tuple, jsonld.documents(g, str(tmp_path / "graph")).collect())) == want and taken == [{"e", "f"}]


def test_ancestors_are_written_once(spark, monkeypatch):
    from lodspark.operators import succession

    rows = []
    written = succession.written
    monkeypatch.setattr(succession, "written", lambda t, path: rows.append(0 if path.endswith("/edges") else t.count()) or written(t, path))
    pairs = spark.createDataFrame([(k, k // 2) for k in range(2, 40)] + [(50, 51), (51, 50)], "child long, parent long")
    found = succession.ancestors(pairs)
    assert found.count() == sum(rows) and {(r.child, r.ancestor) for r in found.filter("child > 49").collect()} == {(50, 51), (51, 50), (50, 50), (51, 51)}
    assert found.filter("child = 39").select("path").orderBy("generation").collect()[-1].path == [19, 9, 4, 2, 1]
