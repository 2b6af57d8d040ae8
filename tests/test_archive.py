import json

import pytest
from pyspark.sql import functions as F

from lodspark.operators import assemble, assertions, checks, dedupe, entities, gazetteer, graph, placequery, store, streets
from lodspark.sources import readers, sinks

POLYGONS = '''fid;psur_id;psur_id2;psur_id3;label_1930;label_1860-79;qid;qid_alt;plantation_label;coords
1;P1;;P3;Alpha;Alpha Oud;Q1;Q2;Alpha;Polygon((558964 644095, 558999 644095, 558999 644195, 558964 644095))
2;;;;Alpha;;Q2;;Alpha;
3;;;;;;;;;Polygon((558964 644095, 558999 644095, 558999 644195, 558964 644095))
4;;;; Beta ;;Q1;;"Beta; the ""new""";
'''
RIVERS = """fid,label1930,main_body_water,label1882,alt_label,wkt_geometry
1,Cotticakreek,Cottica,,,"LineString(558964 644095, 559964 645095)"
2,,Cottica,,,
3,,,Suriname,Soerinam,
"""
ALMANAC = "recordid,year,page,plantation_id,plantation_org,plantation_std,psur_id,product_std,slaven,deserted,loc_std,split1_id,part of_id,district_of_divisie\n" + "\n".join([
    "r1,1840,1,Q1,L'Esp\xe9rance,Esperance,P1,koffie,12.7,,Para Kreek,Q9,,Para", "r2,1841,1,Q1,L'Esp\xe9rance,Esperance,P1,suiker,,,Para Kreek,,,Nickerie", "r3,1842a,,Q1,Esperance,Esperance,,koffie,x,Verlaten,,,Q7,Para",
    ",1840,,Q1,lost,,,,,,,,,", "r5,,,,no org,,,,,", "r6,1840,3,Q5,Only,Only,P9,koffie,3,ja,Weg naar Kwatta,,,Para,too,many",
])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    (d / "polygons.csv").write_text(POLYGONS)
    (d / "rivers.csv").write_text(RIVERS)
    (d / "almanac.csv").write_bytes(ALMANAC.encode("latin-1"))
    return d


def test_plantations(spark, files):
    raw = readers.read_polygons(spark, str(files / "polygons.csv"))
    assert [r.fid for r in raw.orderBy("pos").collect()] == ["1", "2", "3", "4"]
    t = entities.plantations(raw)
    assert [(r.slug, r.status) for r in t["e25"].orderBy("pos").collect()] == [("alpha", "built"), ("alpha-fid-2", "built"), ("fid-3", "unknown"), ("beta-the-new", "built")]
    orgs = {r.qid: r for r in t["e74"].collect()}
    assert orgs["Q1"].absorbed_into == "Q2" and orgs["Q1"].label == "Alpha" and orgs["Q2"].label is None
    names = t["e41"].orderBy("pos", "nth").collect()
    assert [(r.pos, r.text, r.source_year) for r in names] == [(0, "Alpha", "1930"), (0, "Alpha Oud", "1870"), (1, "Alpha", "1930"), (3, "Beta", "1930"), (3, 'Beta; the "new"', "")]
    assert names[1].alt_form_of == names[0].uri == names[2].uri  # a shared label shares its name
    assert t["e53"].count() == 2 and all(r.wkt.startswith("POLYGON((-55.15") for r in t["e53"].collect())
    assert [r.has_polygon for r in t["map_links"].filter("pos = 0").collect()] == [True, False]


def test_rivers(spark, files):
    t = entities.rivers(readers.read_rivers(spark, str(files / "rivers.csv")))
    assert [(r.label, r.feature_type, r.slug) for r in t["e26"].orderBy("pos").collect()] == [("Cotticakreek", "creek", "cotticakreek"), ("Cottica (segment 2)", "river", "fid-2"), ("Suriname", "river", "suriname")]
    assert t["e41"].count() == 3 and t["e53"].count() == 1


def test_almanac(spark, files):
    raw = readers.read_almanac(spark, str(files / "almanac.csv"))
    t = entities.almanac(raw)
    obs = {r.record_id: r for r in t["observations"].collect()}
    assert set(obs) == {"r1", "r2", "r3", "r5", "r6"} and obs["r1"].enslaved == "12" and obs["r3"].year_number == 1842 and obs["r3"].is_abandoned and obs["r6"].is_deserted and not obs["r6"].is_abandoned
    assert obs["r5"].org_uri is None and obs["r1"].split_ids == ["Q9"]
    names = sorted((r.text, r.uri.rsplit("/", 1)[1], r.source_year) for r in t["e41"].collect())
    assert names == [("Esperance", "esperance-almanac-org", "1842a"), ("Esperance", "esperance-almanac-std", "1840"), ("L'Espérance", "lesp-rance-almanac-org", "1840"), ("Only", "only-almanac-org", "1840")]
    assert [r.year for r in t["e22"].collect()] == ["1840", "1841", "1842a"]
    assert sorted((r.src, r.dst, r.kind) for r in entities.merger_edges(t["observations"]).collect()) == [("Q1", "Q7", "part_of"), ("Q1", "Q9", "split")]
    spans = readers.almanac_observations(raw)
    assert spans.count() == 5 and spans.filter("abandoned").count() == 1


def test_gazetteer(spark, files):
    polygons = readers.read_polygons(spark, str(files / "polygons.csv"))
    p, r = entities.plantations(polygons), entities.rivers(readers.read_rivers(spark, str(files / "rivers.csv")))
    obs = entities.almanac(readers.read_almanac(spark, str(files / "almanac.csv")))["observations"]
    rows = gazetteer.seed(p, r, obs, polygons).orderBy("id").collect()
    assert [x.id for x in rows] == [f"stm-{i:05d}" for i in range(1, len(rows) + 1)]
    assert [x.label for x in rows[:2]] == ["Nickerie", "Para"] and [x.type for x in rows[2:7]] == ["river", "river", "creek", "river", "river"]
    assert "waterway" in rows[2].description and "Road" in rows[3].description
    alpha = next(x for x in rows if x.fid == 1 and x.type == "plantation")
    assert (alpha.qid, alpha.district, alpha.broader, alpha.product, alpha.psur_ids, alpha.sources) == ("Q1", "Para", "stm-00002", "koffie", ["P1", "P3"], ["map-1930", "almanakken", "slave-registers"])
    only = rows[-1]
    assert (only.qid, only.label, only.sources, only.lat) == ("Q5", "Only", ["almanakken", "slave-registers"], None)


def test_layers(spark, files, tmp_path):
    (tmp_path / "places.csv").write_text("fid,id,label1930,type1930,remark1930,label1882,type1882,remark1882,X_coord,Y_coord\n1,a,Alpha,,plantation,,,,558964,644095\n2,b,,B,,,,,,\n3,c,,I,,Old Village,dorp,verlaten,558964,644095\n4,d,Cable,Kabelstation,note,Kabel,,,x,y\n")
    (tmp_path / "posts.csv").write_text("fid,label1882,X_coord,Y_coord\n1, Post ,558964,644095\n2,,1,1\n")
    (tmp_path / "roads.csv").write_text('fid,1930,WKT_geometry\n7,x,"LineString(558964 644095, 559964 645095)"\n8,y,\n')
    rail = readers.read_layer(spark, str(tmp_path / "roads.csv"), readers.ROAD_COLUMNS)
    labels = spark.createDataFrame([("ALPHA",)], "label string")
    stages = gazetteer.layers(readers.read_layer(spark, str(tmp_path / "places.csv"), readers.PLACE_COLUMNS), readers.read_layer(spark, str(tmp_path / "posts.csv"), readers.MILITARY_COLUMNS), rail, rail, labels)
    places, posts, roads, rails = [s.orderBy("pos").collect() for s in stages]
    assert [(r.label, r.type, r.description, r.sources) for r in places] == [("Maroon village (fid-2)", "maroon-village", "", ["map-1930"]), ("Old Village", "indigenous-village", "1882: dorp -- verlaten", ["map-1930", "map-1882"]), ("Cable", "station", "note", ["map-1930", "map-1882"])]
    assert places[2].alt_labels == ["Kabel"] and places[2].lat is None and abs(places[1].lat - 5.8237) < 1e-3
    assert [r.label for r in posts] == ["Post"] and [r.label for r in roads] == ["Road segment 7"] and rails[0].alt_labels == ["Lawaspoorweg"] and roads[0].wkt.startswith("LINESTRING(-55.15")


def test_assembled_graph(spark, files):
    p = entities.plantations(readers.read_polygons(spark, str(files / "polygons.csv")))
    r = entities.rivers(readers.read_rivers(spark, str(files / "rivers.csv")))
    a = entities.almanac(readers.read_almanac(spark, str(files / "almanac.csv")))
    g = assemble.graph(spark, p, r, a)
    counts = {x["class"]: x.n for x in graph.class_counts(g).collect()}
    assert counts["E25"] == 4 and counts["E26"] == 3 and counts["E74"] == 2 and counts["E53"] == 3 and counts["E13"] == 5 and counts["E55"] == 12 and counts["E52"] == 3
    assert counts["E22"] == counts["E12"] == 5 and counts["E41"] == 12 and counts[None] == sum(v for k, v in counts.items() if k)
    alpha = json.loads(g.filter("id like '%plantation/alpha'").first().body)
    assert alpha["status"] == "built" and len(alpha["identified_by"]) == 2 and len(alpha["depicted_on"]) == 2
    features = [json.loads(x.body) for x in assemble.features(p, r).orderBy("pos").collect()]
    assert features[0]["geometry"]["type"] == "Polygon" and len(features[0]["geometry"]["coordinates"][0]) == 4 and features[0]["properties"]["names"] == ["Alpha", "Alpha Oud"]
    assert features[-1]["geometry"]["type"] == "LineString" and features[-1]["properties"]["type"] == "creek"
    report = {(x.entity, x.link): (x.linked, x.total) for x in checks.link_coverage(assemble.coverage(p, r, a)).collect()}
    assert report[("E25", "owner")] == (3, 4) and report[("E13", "organization")] == (4, 5)
    assert checks.dangling(assemble.source_years(spark, a), assemble.time_spans(a)).select("dst").orderBy("dst").collect()[0].dst.endswith("1870")


def test_documents_and_presence(spark, files, tmp_path):
    rows = spark.createDataFrame([(1, '{"@id":"a","@type":"crm:E25_x"}'), (0, '{"@id":"b","@type":["crm:E53_y","z"],"typeId":"t","prefLabel":"only"}')], "pos long, body string")
    assert sinks.jsonld(rows, str(tmp_path / "g"), "2024-01-01T00:00:00Z") == 2
    sinks.joined(spark, str(tmp_path / "g"), str(tmp_path / "g.jsonld"))
    sinks.lines(spark.createDataFrame([("a", "crm:E25_x"), ("b", "z")], "`@id` string, `@type` string"), str(tmp_path / "lines"))
    assert sorted((r.id, r.types) for r in readers.read_graph_lines(spark, str(tmp_path / "lines")).select("id", F.col("types").cast("array<string>").alias("types")).collect()) == [("a", ["crm:E25_x"]), ("b", ["z"])]
    assert [e["@id"] for e in json.loads((tmp_path / "g.jsonld").read_text())["@graph"]] == ["b", "a"]
    back = readers.read_graph(spark, str(tmp_path / "g.jsonld"))
    assert [(r.id, r.c) for r in back.orderBy("pos").select("id", graph.classify(F.col("types")).alias("c")).collect()] == [("b", "E53"), ("a", "E25")]
    assert [(c.type_id, c.label_en, c.sort_order) for c in readers.concepts(back).collect()] == [("t", "only", 99)]
    (tmp_path / "p.csv").write_text("qid;x\nQ1;1\nQ1;2\nnone;3\n")
    got = readers.read_presence(spark, [readers.PresenceSource("map-1916", 1916, str(tmp_path / "p.csv"), sep=";")])
    assert [tuple(r) for r in got.collect()] == [("Q1", "map-1916", 1916)]


def test_streets(spark, tmp_path):
    line = lambda *p: {"type": "LineString", "coordinates": [list(x) for x in p]}
    feats = [("Heiligen Weg", 5, line((0, 0), (2, 2))), ("heiligen-weg", 6, {"type": "MultiLineString", "coordinates": [[[2, 2], [4, 4]]]}), ("[naamloos]", 7, line((0, 0), (1, 1))), (None, None, line((0, 0), (1, 1))), ("Gone", 8, None), ("Dot", 9, {"type": "Point", "coordinates": [1, 2]}), ("Twice", 10, line((0, 0), (1, 1))), ("Short", 11, line((0, 0)))]
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Name": n, "ID": i}, "geometry": g} for n, i, g in feats]}))
    features = readers.read_geojson(spark, str(tmp_path / "s.geojson"))
    assert streets.counters(features).first().asDict() == {"skipped": 2, "unnamed": 2}
    agg = streets.aggregate(features)
    weg = agg.filter("key = 'heiligen weg'").first()
    assert weg.label == "Heiligen Weg" and weg.ids == [5, 6] and len(weg.segments) == 2
    places = spark.createDataFrame([("stm-00001", "HEILIGEN WEG", "road", None, None, None, None, ["x"]), ("stm-00002", "Twice", "road", None, None, None, None, []), ("stm-00003", "twice", "road", None, None, None, None, []), ("stm-00009", "other", "road", None, None, None, 7, ["map-1916"])], "id string, label string, type string, lat double, lng double, wkt string, fid int, sources array<string>")
    plan = streets.plan(agg, places, "map-1916")
    assert sorted((r.label, r.outcome, r.target) for r in plan.collect()) == [("Heiligen Weg", "update", "stm-00001"), ("Short", "no geometry", None), ("Twice", "conflict", None), ("Unnamed street 1916 #-1", "insert", None), ("Unnamed street 1916 #7", "update", "stm-00009")]
    after = {r.id: r for r in streets.apply(plan, places, "map-1916").collect()}
    assert len(after) == 5 and after["stm-00010"].label == "Unnamed street 1916 #-1" and after["stm-00001"].lat == 2.0 and after["stm-00001"].sources == ["x", "map-1916"]
    again = streets.plan(agg, spark.createDataFrame(list(after.values()), places.schema), "map-1916")
    assert again.filter("outcome = 'insert'").count() == 0  # a second run inserts nothing
    (tmp_path / "bad.geojson").write_text('{"type": "Feature", "features": []}')
    with pytest.raises(Exception, match="not a FeatureCollection"):
        readers.read_geojson(spark, str(tmp_path / "bad.geojson")).collect()


def test_store(spark, tmp_path):
    s = sinks.SnapshotStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    assert s.version() == 0 and s.write(first, 0) == 1
    new = lambda t: store.replace_by_key(t, spark.createDataFrame([(2, "c"), (3, "d")], "id long, label string"), "id")
    s.change(new, dry_run=True)
    assert s.version() == 1
    s.change(new)
    s.change(new)  # nothing changes any more
    assert s.version() == 2 and sorted(map(tuple, s.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(sinks.Conflict):
        s.write(first, 1)
    with pytest.raises(Exception, match="no such luck"):
        s.change(lambda t: t.withColumn("label", F.raise_error(F.lit("no such luck"))))
    assert s.write(first, 2) == 3  # neither a failure nor a conflict leaves a claim behind
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["v=1", "v=2", "v=3"]


def test_sequence_keeps_rows_without_position(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 1), ("d", 70_000), ("e", None)], "name string, pos long")
    out = dedupe.in_sequence([rows, rows.limit(0), rows.filter("pos = 70000")]).collect()
    assert sorted(r.seq for r in out) == [1, 2, 3, 4, 5, 6]
    at = {r.seq: r.name for r in out}
    assert {at[1], at[2]} == {"b", "e"} and {at[3], at[4]} == {"a", "c"} and at[5] == at[6] == "d"
    assert dedupe.in_sequence([spark.createDataFrame([("x", 1), ("y", None)], "name string, pos long")]).count() == 2


def test_index_set_and_trees(spark):
    g = spark.createDataFrame([("a", "E25", "{}"), ("n1", "E41", '{"identifies":"a"}'), ("n2", "E41", '{"identifies":"a"}'), ("n3", "E41", "{}"), ("o", "E13", '{"about":"q"}'), ("s", "E22", "{}"), ("t", "E55", "{}")], "id string, class string, body string")
    index = sinks.index_set(g, spark.createDataFrame([("p", "{}")], "id string, body string"))
    assert {k: sorted((r.key, r.id) for r in t.collect()) for k, t in index.items()} == {
        "plantations": [("a", "a")], "physical_features": [], "organizations": [], "places": [], "sources": [("s", "s")],
        "appellations_by_entity": [("a", "n1"), ("a", "n2")], "observations_by_org": [("q", "o")], "provenance": [("p", "p")],
    }
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("l", "gone")], "id string, broader string")
    assert sorted(map(tuple, graph.tree(nodes).collect())) == [("a", "r", 1), ("b", "r", 2), ("r", "r", 0)]
    with pytest.raises(ValueError, match="levels"):
        graph.tree(nodes, levels=1)
    circle = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b")], "src string, dst string")
    assert sorted(map(tuple, graph.hops(circle, 3).collect())) == [("a", "a", 2), ("a", "b", 1), ("a", "b", 3), ("b", "a", 1), ("b", "a", 3), ("b", "b", 2)]


def test_presence_is_idempotent(spark):
    kind = "a array<struct<id:string,status:string,source:string,start_year:int,end_year:int>>"
    df = spark.createDataFrame([([("1", "built", "x", 1900, None), ("2", "built", "y", 1950, None)],), ([],)], kind)
    add = lambda c: assertions.add_presence(c, F.lit("map-1930"), F.lit(1930), F.lit("n"))
    once, twice = df.select(add(F.col("a")).alias("a")), df.select(add(add(F.col("a"))).alias("a"))
    assert [[x.start_year for x in r.a] for r in once.collect()] == [[1900, 1930, 1950], [1930]]
    assert once.collect() == twice.collect()


def test_place_query(spark):
    rows = [("a", "plantation", "Alpha", ["Alfa"], ["map-1930"], ["doc"], False, None, True), ("b", "river", "Beta", [], ["map-1930", "x"], [], None, None, False), ("c", "river", "Gamma", [], [], [], True, None, True), ("d", "river", "Delta", None, ["x"], None, False, "a", None)]
    places = spark.createDataFrame(rows, "id string, type string, label string, names array<string>, sources array<string>, documents array<string>, deprecated boolean, merged_into string, flag boolean")
    ids = lambda **k: [r.id for r in placequery.PlaceQuery(**k).run(places).collect()]
    assert ids() == ["a", "b"] and ids(show_merged=True) == ["a", "b", "d"]
    assert ids(sources=["map-1930", "documents"], mode="and") == ["a"] and ids(sources=["x", "documents"]) == ["a", "b"] and ids(exclude=["x"]) == ["a"]
    assert ids(text=" ALF ") == ["a"] and ids(types=["river"], show_merged=True, sort="flag") == ["b", "d"]


def test_place_query_looks_into_all_fields(spark):
    kind = "id string, type string, label string, names array<string>, sources array<string>, documents array<string>, deprecated boolean, merged_into string, district string, location string, psur_ids array<string>, external_links array<struct<authority:string,identifier:string>>"
    rows = [("a", "x", "Alpha", None, [], [], False, None, "Para", None, ["P12"], [("wikidata", "Q77")]), ("b", "x", "Beta", ["Other"], [], [], None, None, None, "at the Creek", None, None), ("c", "x", None, None, [], [], None, None, None, None, None, [("geonames", "9"), ("wikidata", "Q1")])]
    places = spark.createDataFrame(rows, kind)
    ids = lambda **k: [r.id for r in placequery.PlaceQuery(**k).run(places).collect()]
    assert ids(text="para") == ["a"] and ids(text="p1") == ["a"] and ids(text="q77") == ["a"] and ids(text="WIKI") == ["a", "c"] and ids(text="creek") == ["b"] and ids(text="other") == ["b"]
    assert ids(sort="links") == ["a", "c", "b"] and ids(sort="links", descending=True) == ["c", "a", "b"]


def test_ends_and_report_of_a_graph(spark):
    g = spark.createDataFrame([("a", "E25", '{"place":"p","owner":"nobody","depicted_on":[]}'), ("p", "E53", '{"geometry":"POLYGON((-55 4, -54 4, -54 5, -55 4))"}'), ("q", "E53", '{"geometry":"POLYGON((5 4, 6 4, 6 5, 5 4))"}'), ("n", "E41", '{"content":" ","identifies":["a","zz"]}'), ("o", "E24", "{}")], "id string, class string, body string")
    told = {r.check: (r.linked, r.total) for r in checks.report(g).collect()}
    assert len(told) == 18 and told["retired class E24"] == (1, 1) and told["E25 with location"] == (1, 1) and told["E25 with representation"] == (0, 1) and told["E41 with content"] == (0, 1) and told["Polygons in the country"] == (1, 2)
    assert sorted(map(tuple, checks.ends(g, ["place", "owner", "identifies"]).collect())) == [("a", "owner", "nobody"), ("a", "place", "p"), ("n", "identifies", "a"), ("n", "identifies", "zz")]
    plan = checks.report(g)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
