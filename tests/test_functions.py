import unicodedata

import pytest
from pyspark.sql import functions as F

from lodspark.functions import geo, lang, text, uri


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (text.slugify, "  L'Espérance  & Co. ", "lesp-rance-co"),
        (text.slugify, None, None),
        (text.slug_value, " L'a--b ", "l-a-b"),
        (text.slug_term, " Sugar  Mill ", "sugar-mill"),
        (text.normalize_label, "Heiligen-Weg  é", "heiligen weg e"),
        (text.normalize_label, "Ça é Ő", "ca e o"),
        (text.int_prefix, " 1846a", 1846),
        (text.int_prefix, "x1", None),
        (text.int_prefix, "", None),
        (text.safe_int, "12.9 x", "12"),
        (text.safe_int, None, ""),
        (text.nonzero_int, "0", None),
        (text.last_number, "stm-00042", 42),
        (text.last_number, "none", 2**53 - 1),
        (uri.place_id, "https://x/place/stm-02542", "stm-02542"),
        (uri.place_id, "abc", "abc"),
        (uri.compact, "http://www.wikidata.org/entity/Q1", "wd:Q1"),
        (uri.label_of, "urn:x", "urn:x"),
        (lang.crm_badge, "crm:E25_Human_Made_Feature", "E25"),
    ],
)
def test_scalars(spark, function, value, want):
    assert one(spark, value, function) == want


def test_fold_is_unicode_decomposition(spark):
    chars = "".join(chr(c) for c in range(0xC0, 0x180))
    got = one(spark, chars, text.fold)
    want = "".join(x for x in unicodedata.normalize("NFKD", chars) if not unicodedata.combining(x))
    kept = [(a, b) for a, b in zip(chars, got, strict=True) if unicodedata.normalize("NFKD", a) != a and len(unicodedata.normalize("NFKD", a)) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", a)[1])]
    assert all(b == unicodedata.normalize("NFKD", a)[0] for a, b in kept) and kept and want


def test_links(spark):
    df = spark.createDataFrame([("stm-1", 3.4, 5.12345, None), (None, None, None, None)], "p string, z double, lat double, lng double")
    links = [r.r for r in df.select(uri.explore_url(F.col("p"), F.col("z"), F.col("lat"), F.col("lng")).alias("r")).collect()]
    assert links == ["/explore?place=stm-1&z=3&lat=5.1235", "/explore"]
    back = one(spark, "/explore?place=a%20b&z=99&lat=-91&lng=12.5x", uri.explore_parameters)
    assert back.asDict() == {"place": "a b", "z": None, "lat": None, "lng": 12.5}


def test_language_maps(spark):
    rows = [('"one"',), ('["a", "b"]',), ('{"en": "", "nl": "weg"}',), (None,)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("v"))
    got = df.select(lang.as_array(F.col("v")).alias("a"), lang.lang_en(lang.as_lang_map(F.col("v"))).alias("m")).collect()
    assert [r.a for r in got[:2]] == [["one"], ["a", "b"]] and got[3].a == []
    assert [r.m for r in got] == ["one", "", "weg", ""]
    m = spark.createDataFrame([({"en": "a", "nl": "b"},)], "m map<string,string>")
    assert m.select(lang.set_lang(F.col("m"), "en", F.lit("c")).alias("r")).first().r == {"nl": "b", "en": "c"}
    assert m.select(lang.set_lang(F.col("m"), "en", F.lit(" ")).alias("r")).first().r == {"nl": "b"}
    assert one(spark, " a, ,b", lang.split_list) == ["a", "b"]
    assert one(spark, ["x", "almanakken"], lang.preferred_source, "v array<string>") == "almanakken"


@pytest.mark.parametrize(
    ("x", "y", "lng", "lat"),
    [(558964.520359115, 644095.622717077, -55.15207353, 5.82366039), (624943.891629353, 655560.685937372, -54.55593215, 5.92648095), (316355.826620839, 588040.035029874, -57.34191775, 5.31457291)],
)
def test_reprojection(spark, x, y, lng, lat):
    p = spark.createDataFrame([(x, y)], "x double, y double").select(geo.reproject(F.col("x"), F.col("y")).alias("p")).first().p
    assert abs(p.lng - lng) < 1e-6 and abs(p.lat - lat) < 1e-6 and -58 < p.lng < -53 and 1 < p.lat < 7


def test_well_known_text(spark):
    assert one(spark, "POLYGON((0 0, 2 0, 2 2))", geo.polygon_ring) is None
    ring = one(spark, "Polygon ((0 0, 2 0, bad x, 2 2, 0 0))", geo.polygon_ring)
    assert [(p.x, p.y) for p in ring] == [(0, 0), (2, 0), (2, 2), (0, 0)]
    assert one(spark, "", geo.line_points) is None
    parts = one(spark, "MULTILINESTRING((0 0, 1 1), (5 5), (2 2, 3 3))", geo.segments)
    assert len(parts) == 2
    again = one(spark, "MULTILINESTRING((0 0, 1 1), (5 5), (2 2, 3 3))", lambda c: geo.write_multiline(geo.segments(c)))
    assert again == "MULTILINESTRING((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0))"
    assert one(spark, "x", lambda c: geo.write_multiline(geo.segments(c))) is None
    c = one(spark, "Polygon((0 0, 2 0, 2 2, 0 0))", lambda w: geo.mean_point(geo.polygon_ring(w)))
    assert (c.x, c.y) == (1.0, 0.5)


def test_grid_against_a_forward_projection(spark):
    """Points go to the grid by an integrated meridian arc and a series in longitude, and come back by `reproject`; the shift is undone by iteration."""
    import math

    a, f, k0, lon0 = 6378388.0, 1 / 297, 0.9996, math.radians(-55.68333333333)
    e2 = f * (2 - f)

    def arc(lat, n=2000):
        h = lat / n
        y = [a * (1 - e2) / (1 - e2 * math.sin(k * h) ** 2) ** 1.5 for k in range(n + 1)]
        return h / 3 * (y[0] + y[-1] + 4 * sum(y[1:-1:2]) + 2 * sum(y[2:-1:2]))

    def to_grid(lat, lon):
        w, s, c, t = lon - lon0, math.sin(lat), math.cos(lat), math.tan(lat)
        nu, rho = a / math.sqrt(1 - e2 * s * s), a * (1 - e2) / (1 - e2 * s * s) ** 1.5
        psi = nu / rho
        east = nu * w * c * (1 + w**2 * c**2 / 6 * (psi - t**2) + w**4 * c**4 / 120 * (4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - psi * 2 * t**2 + t**4))
        north = arc(lat) + nu * s * w**2 * c / 2 * (1 + w**2 * c**2 / 12 * (4 * psi**2 + psi - t**2) + w**4 * c**4 / 360 * (8 * psi**4 * (11 - 24 * t**2) - 28 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 - 32 * t**2) - psi * 2 * t**2 + t**4))
        return 500000 + k0 * east, k0 * north

    def shifted(lat, lon):
        nu = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        x, y, z = nu * math.cos(lat) * math.cos(lon) - 265, nu * math.cos(lat) * math.sin(lon) + 120, nu * (1 - e2) * math.sin(lat) - 358
        wa, we2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
        p, new = math.hypot(x, y), math.atan2(z, math.hypot(x, y))
        for _ in range(20):
            n = wa / math.sqrt(1 - we2 * math.sin(new) ** 2)
            new = math.atan2(z + we2 * n * math.sin(new), p)
        return math.degrees(new), math.degrees(math.atan2(y, x))

    places = [(math.radians(lat), math.radians(lon)) for lat in (2.0, 4.5, 5.83) for lon in (-57.9, -55.68333333333, -55.1, -54.0)]
    rows = [(*to_grid(*p), *shifted(*p)) for p in places]
    got = spark.createDataFrame(rows, "x double, y double, lat double, lng double").withColumn("p", geo.reproject(F.col("x"), F.col("y"))).collect()
    assert all(abs(r.p.lat - r.lat) < 1e-8 and abs(r.p.lng - r.lng) < 1e-8 for r in got)
