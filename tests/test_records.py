from pyspark.sql import functions as F

from lodspark.operators import checks, dedupe, matching, merging, registers, store
from lodspark.plans import lookup, quality
from lodspark.streaming.sessions import sessions

NAMES = "names array<struct<text:string,language:string,type:string,is_preferred:boolean,source:string,source_year:int>>"


def test_one_name_is_preferred(spark):
    df = spark.createDataFrame([([("a", "nl", "x", False, None, None), ("b", "nl", "x", True, None, None), ("c", "nl", "x", True, None, None)],), ([("a", "nl", "x", None, None, None)],), ([],)], NAMES)
    got = [[n.is_preferred for n in r.n] for r in df.select(merging.one_preferred(F.col("names")).alias("n")).collect()]
    assert got == [[False, True, False], [True], []]
    got = df.select(merging.one_preferred(F.col("names"), F.lit("c")).alias("n")).first().n
    assert [n.is_preferred for n in got] == [False, False, True]


def test_legacy_names_and_summary(spark):
    df = spark.createDataFrame([(None, "Main", ["Old"]), (None, " ", None), ([("kept", "nl", "x", True, None, None)], "Main", ["Old"])], NAMES + ", label string, alt array<string>")
    got = [[(n.text, n.is_preferred) for n in r.n] for r in df.select(merging.from_legacy(F.col("names"), F.col("label"), F.col("alt")).alias("n")).collect()]
    assert got == [[("Main", True), ("Old", False)], [], [("kept", True)]]
    s = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],)], "s array<string>").select(merging.summary(F.col("s")).alias("r"))
    assert [r.r for r in s.collect()] == ["a + b + 1 more", "a"]


def test_roles_and_spells(spark):
    c = spark.createDataFrame([(1, "Jan", "Piet", None, "Kees", " "), (2, None, None, None, None, None)], "id int, death_name string, parent_name_1 string, parent_name_2 string, spouse_name_3 string, wts_name_1 string")
    got = registers.roles(c, registers.DEATH_ROLES, ["name"]).orderBy("role", "nth").collect()
    assert [tuple(r) for r in got] == [(1, "death", 1, "Jan"), (1, "parent", 1, "Piet"), (1, "spouse", 3, "Kees")]
    r = spark.createDataFrame([(1, "01-02-1840", "birth", None, "sold"), (2, None, None, "bad", None)], "id int, start_date string, start_event string, end_date string, end_event string")
    assert [(x.id, x.event, str(x.date), x.remark) for x in registers.spells(r).orderBy("event").collect()] == [(1, "end", "None", "sold"), (1, "start", "1840-02-01", "birth")]


def test_person_links_equal_all_pairs(spark):
    names = ["jan pieter", "jan pietre", "jan", "ja", "j", "maria", "marie", "mara", "xmaria", "", "petronella", "petronela", "etronella"]
    a = spark.createDataFrame([(i, "b", n) for i, n in enumerate(names)], "id int, ward string, name string")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, last = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    want = sorted((i, j, edits(x, y)) for i, x in enumerate(names) for j, y in enumerate(names) if x and y and edits(x, y) <= 2)
    assert sorted(map(tuple, registers.linked_persons(a, a, ["ward"], "name").collect())) == want


def test_whole_person_links_take_all_rows_and_whole_names(spark, tmp_path):
    names = ["johanna petronella", "johanna petronela", "johanna petrus", "johanna petronella", "johanna petrux", "Johanna  Petrus!", None, "", "a", "abc"]
    rows = [(2 * i, n, i % 2) for i, n in enumerate(names)] + [(2 * i, n, 2) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, last = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    key = lambda n: " ".join((n or "").lower().replace("!", "").split())
    want = {(i, j, edits(key(x), key(y))) for i, x, g in rows for j, y, h in rows if g == h and key(x) and key(y) and edits(key(x), key(y)) <= 2}
    got = quality.QUERIES["person_links_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and "person_links_whole" not in quality.SQL


def test_lines_have_a_depth(spark, tmp_path):
    tables = {
        "lineitem": ("l_orderkey long, l_linenumber int", [(1, 1), (1, 2), (2, 1), (9, 1)]), "orders": ("o_orderkey long, o_custkey long", [(1, 5), (2, 6), (3, 6)]),
        "customer": ("c_custkey long, c_nationkey int", [(5, 0), (6, 1)]), "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1), (2, 1)]),
    }
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in lookup.QUERIES["provenance_depth_lines"](spark, str(tmp_path)).collect()}
    assert got == {("r0", 1, 1), ("r1", 1, 2), ("r0", 2, 1), ("r1", 2, 1), ("r0", 3, 1), ("r1", 3, 2), ("r0", 4, 2), ("r1", 4, 1)}


def test_sequence_and_last_wins(spark):
    a, b = spark.range(5).select(F.col("id").alias("pos")), spark.range(3).select(F.col("id").alias("pos"))
    got = dedupe.in_sequence([a, b]).orderBy("seq").collect()
    assert [(r.stage, r.pos, r.seq) for r in got] == [*[(0, i, i + 1) for i in range(5)], *[(1, i, i + 6) for i in range(3)]]
    t = spark.createDataFrame([("k", 1, 0), ("k", 2, 1), ("l", 3, 2)], "key string, v int, pos int")
    assert sorted((r.key, r.v, r.first_pos) for r in dedupe.last_wins(t, ["key"], "pos").collect()) == [("k", 2, 0), ("l", 3, 2)]


def test_two_keys_and_conflicts(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "name string, fid int")
    known = spark.createDataFrame([("a", 9, "x"), ("b", 8, "y"), ("b", 2, "z"), ("e", 3, "w")], "name string, fid int, target string")
    got = {r.name: (r.match, r.outcome) for r in matching.ambiguous(items, known, ["name", "fid"], "target").collect()}
    assert got == {"a": ("x", "update"), "b": (None, "conflict"), "c": ("w", "update"), "d": (None, "insert")}


def test_tombstones_and_merges(spark):
    t = spark.createDataFrame([(1, False, None, None, None, None), (2, True, None, "x", "y", None), (3, None, 1, None, None, None)], "id int, deprecated boolean, merged_into int, deprecated_by string, deprecated_at string, note string")
    new, judged = store.tombstone(t, spark.createDataFrame([(i, "me", "2024", " n ") for i in (1, 2, 3, 4)], "id int, actor string, at string, note string"))
    assert {r.id: r.status for r in judged.collect()} == {1: "200", 2: "409", 3: "409", 4: "404"}
    assert {r.id: (r.deprecated, r.deprecated_by, r.note) for r in new.collect()} == {1: (True, "me", "n"), 2: (True, "x", None), 3: (None, None, None)}
    new, judged = store.merge(t, spark.createDataFrame([(1, 2), (3, 1), (1, 1), (1, 7)], "keep int, retire int"))
    assert sorted(r.status for r in judged.collect()) == ["200", "400", "400", "404"]
    assert {r.id: r.merged_into for r in new.collect()} == {1: None, 2: 1, 3: 1}


def test_chain_and_levels(spark):
    df = spark.createDataFrame([("s", "f", None, None), (None, None, None, None), ("s", "f", "3", "scan")], "s string, f string, r string, o string")
    got = df.select(checks.provenance_level(F.col("s"), F.col("f"), F.col("r"), F.col("o")).alias("d"), F.size(checks.chain(("source", F.col("s")), ("row", F.col("r")))).alias("n")).collect()
    assert [tuple(r) for r in got] == [("D2", 1), (None, 0), ("D4", 2)]


def test_sessions_run_on_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.sql("SELECT 1L AS u, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1L, timestamp'2024-01-01 00:05:00' UNION ALL SELECT 1L, timestamp'2024-01-01 02:00:00' UNION ALL SELECT 2L, timestamp'2024-01-03 00:00:00'").write.parquet(str(src))
    stream = sessions(spark.readStream.schema("u long, ts timestamp").parquet(str(src)), "u", "ts", "10 minutes", late="1 hour")
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = sorted((r.u, r.n) for r in spark.read.schema("u long, n long").parquet(str(out)).collect())
    assert closed == [(1, 1), (1, 2)]  # the last session stays open: nothing later has come


def test_patches_keep_every_row(spark):
    kind = "id long, label string, type string, external_links array<struct<authority:string,identifier:string>>, qid string, crm_class string, modified_by string, modified_at string, has string"
    places = spark.createDataFrame([(1, "a", "river", [], "Q1", "old", None, None, "x"), (None, "b", "river", None, "Q2", "old", None, None, "x"), (2, "c", "river", [], "Q3", "old", None, None, "x"), (2, "d", "river", [], "Q4", "old", None, None, "x")], kind)
    patches = spark.createDataFrame([(1, ["label", "type"], "new", None, "me", "now")], "id long, has array<string>, label string, type string, actor string, at string")
    new, told = store.patch_places(places, patches, ["label", "type"])
    rows = sorted(((r.id or 0, r.label, r.type, r.qid, r.crm_class, r.modified_by, r.has) for r in new.collect()), key=str)
    assert rows == sorted([(0, "b", "river", "Q2", "old", None, "x"), (1, "new", None, None, rows[1][4], "me", "x"), (2, "c", "river", "Q3", "old", None, "x"), (2, "d", "river", "Q4", "old", None, "x")], key=str)
    assert rows[1][4] != "old" and new.columns == places.columns and [tuple(r) for r in told.collect()] == [(1, "200")]


def test_sequences_keep_columns_named_like_their_own(spark):
    names = ["before", "part", "tie", "placed", "size", "row"]
    one = spark.createDataFrame([(k, *[f"{n}{k}" for n in names]) for k in (3, 1, 2)], "pos long, " + ", ".join(f"{n} string" for n in names))
    out = dedupe.in_sequence([one, one.withColumn("pos", F.lit(None).cast("long"))])
    assert out.columns == ["pos", *names, "stage", "seq"]
    rows = out.orderBy("seq").collect()
    assert [r.pos for r in rows] == [1, 2, 3, None, None, None] and [r.seq for r in rows] == [1, 2, 3, 4, 5, 6]
    assert all(r[n] == f"{n}{r.pos}" for r in rows[:3] for n in names)


def test_sources_and_concepts_answer_each_request(spark):
    rows = spark.createDataFrame([("a", "A", "x", None), ("b", "B", "x", "old"), (None, "N", "x", None), ("b", "B2", "x", None)], "id string, label string, category string, modified_by string")
    asked = spark.createDataFrame([("b", ["label", "id"], None, "me", "1"), ("b", ["label"], "late", "me", "2"), ("z", ["label"], "q", "me", "1"), (None, ["label"], "q", "me", "1"), ("a", ["id"], "q", "me", "1"), ("a", None, "q", "me", "1")], "id string, has array<string>, label string, actor string, at string")
    new, told = store.patch_rows(rows, asked, "id", ["label"])
    assert sorted(map(tuple, new.collect()), key=str) == sorted([("a", "A", "x", None), ("b", None, "x", "me"), (None, "N", "x", None), ("b", None, "x", "me")], key=str)
    assert sorted((str(r.id), r.status) for r in told.collect()) == [("None", "400"), ("a", "400"), ("a", "400"), ("b", "200"), ("b", "409"), ("z", "404")]
    concepts = spark.createDataFrame([("river", {"en": "River"}, 3, True)], "type string, labels map<string,string>, sort_order int, deprecated boolean")
    wanted = spark.createDataFrame([(" creek ", {"en": "Creek", "nl": " "}, "1"), ("creek", {"en": "Later"}, "2"), ("river", {"en": "x"}, "1"), ("lake", {"nl": "Meer"}, "1"), ("", {"en": "x"}, "1"), (None, None, "1")], "type string, labels map<string,string>, at string")
    after, told = store.create_concepts(concepts, wanted)
    assert sorted((r.type, r.labels, r.sort_order) for r in after.collect()) == [("creek", {"en": "Creek"}, 99), ("river", {"en": "River"}, 3)]
    assert sorted((str(r.type), r.status) for r in told.collect()) == [("None", "400"), ("None", "400"), ("creek", "201"), ("creek", "409"), ("lake", "400"), ("river", "409")]
    two = after.select("type", "labels")
    kept, status = store.replace_thesaurus(concepts, two, "{}")
    assert status == "200" and kept.count() == 2 and kept.columns == concepts.columns
    for bad, context in ((two, ""), (two, None), (two.limit(0), "{}"), (two.unionByName(two), "{}"), (two.withColumn("type", F.lit(None).cast("string")), "{}")):
        assert store.replace_thesaurus(concepts, bad, context)[1] == "400"
