import json

from lodspark.operators import jsonld

CRM, XSD = "http://www.cidoc-crm.org/cidoc-crm/", "http://www.w3.org/2001/XMLSchema#"
BODIES = {
    "a": {"prefLabel": {"nl": "Naam", "en": 'Na"me\\ é'}, "P53_has_location": "place/1", "P1_is_identified_by": ["n/2", "n/1"], "sizeAkkers": 12, "deserted": True, "other": "x", "observationYear": "1846"},
    "b": {"fid": 0, "asWKT": "POINT(1 2)", "altLabel": ["one", "two", "one"], "empty": [], "none": None, "looks": "[1, 2]", "object": '{"a":1}', "dcterms:description": "d\nd"},
    "c": {"http://example.org/full": "y", "fid": "not a number", "deserted": "maybe", "sizeAkkers": ["1", "x"]},
}


def frame(spark, bodies):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("d", "{}"), ("e", None)], "id string, body string")


def test_expansion_says_what_the_context_says(spark):
    rows = {(r.id, r.property, r.kind, r.value, r.language, r.nth) for r in jsonld.expand(frame(spark, BODIES)).collect()}
    assert {x for x in rows if x[0] == "a"} == {
        ("a", "http://www.w3.org/2004/02/skos/core#prefLabel", "", 'Na"me\\ é', "en", 0), ("a", "http://www.w3.org/2004/02/skos/core#prefLabel", "", "Naam", "nl", 1),
        ("a", CRM + "P53_has_former_or_current_location", "@id", "place/1", None, 0), ("a", CRM + "P1_is_identified_by", "@id", "n/2", None, 0), ("a", CRM + "P1_is_identified_by", "@id", "n/1", None, 1),
        ("a", CRM + "P43_has_dimension", XSD + "integer", "12", None, 0), ("a", CRM + "P141_assigned", XSD + "boolean", "true", None, 0), ("a", "https://schema.org/other", "", "x", None, 0), ("a", CRM + "P4_has_time-span", XSD + "gYear", "1846", None, 0),
    }
    assert not [x for x in rows if x[0] in ("d", "e") or x[1].endswith(("empty", "none"))]
    assert ("b", "https://schema.org/looks", "", "[1, 2]", None, 0) in rows


def test_round_trip(spark):
    rows = jsonld.expand(frame(spark, {k: v for k, v in BODIES.items() if k != "c"}))
    back = jsonld.compact(rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(jsonld.expand(back)) == key(rows)
    bodies = {r.id: json.loads(r.body) for r in back.collect()}
    assert bodies["a"] == {**{k: v for k, v in BODIES["a"].items() if k != "observationYear"}, "mapYear": "1846"}, "two terms of one meaning: the least is written"
    assert bodies["b"] == {k: v for k, v in BODIES["b"].items() if k not in ("empty", "none")}
    odd = jsonld.expand(frame(spark, {"c": BODIES["c"]}))
    assert {r.value for r in jsonld.expand(jsonld.compact(odd)).collect()} == {r.value for r in odd.collect()}
    assert jsonld.compact(rows.limit(0)).count() == 0


def test_every_term_makes_the_round(spark):
    of = {t: (p, k) for t, p, k in jsonld._term_table()}
    value = {XSD + "integer": 7, XSD + "boolean": False}
    nodes = frame(spark, {t: {t: value.get(k, "v")} for t, (p, k) in of.items()})
    rows = jsonld.expand(nodes)
    assert {(r.id, r.property, r.kind) for r in rows.collect()} == {(t, p, k) for t, (p, k) in of.items()}
    assert sorted(map(str, jsonld.expand(jsonld.compact(rows)).collect())) == sorted(map(str, rows.collect()))
    said = jsonld.context()
    assert len(of) == sum(map(len, jsonld.TERMS.values())) and said["fid"] == {"@id": "crm:P48_has_preferred_identifier", "@type": "xsd:integer"} and said["prefLabel"] == "skos:prefLabel"


def test_documents_of_a_graph(spark):
    g = spark.createDataFrame([("x", "E25", '{"label":"L","owner":"o","identified_by":["n1","n2"],"depicted_on":["m"]}'), ("x", "E25", '{"label":"L","place":"p"}'), ("s", "E13", '{"size":5,"deserted":false,"year":"1830","name":"N","product":"P"}')], "id string, class string, body string")
    got = {r.id: json.loads(r.body) for r in jsonld.documents(g).collect()}
    assert got["x"] == {"prefLabel": "L", "P52_has_current_owner": "o", "P1_is_identified_by": ["n1", "n2"], "P138i_has_representation": "m", "P53_has_location": "p"}
    assert got["s"] == {"sizeAkkers": 5, "deserted": False, "observationYear": "1830", "observedName": "N", "product": "P"}


def test_archive_makes_the_round(spark, tmp_path):
    from lodspark.operators import assemble
    from lodspark.plans import archive

    docs = jsonld.documents(assemble.graph(spark, *archive._all(spark, "/root/testdata/sf0.001", str(tmp_path))))
    docs.select("id", "body").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = jsonld.expand(docs)
    assert rows.count() > docs.count()
    again = jsonld.expand(jsonld.compact(rows))
    one, two = (sorted((r.id, r.property, r.kind, r.value) for r in t.collect()) for t in (rows, again))
    assert one == two
