"""JSON-LD by its context: properties as rows of full names, and back to documents of short terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Namespaces of the context: fixed values.
PREFIXES = {
    "wd": "http://www.wikidata.org/entity/", "wdt": "http://www.wikidata.org/prop/direct/", "crm": "http://www.cidoc-crm.org/cidoc-crm/", "geo": "http://www.opengis.net/ont/geosparql#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#", "sdo": "https://schema.org/", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "dcterms": "http://purl.org/dc/terms/", "oa": "http://www.w3.org/ns/oa#", "picom": "https://personsincontext.org/model#", "picot": "https://personsincontext.org/thesaurus#",
}
#: Name space of terms that the context does not list.
VOCABULARY = "https://schema.org/"
#: Terms of the context by the kind of their values, with the property that they stand for: fixed values.
TERMS = {
    "@id": {
        "P1_is_identified_by": "crm:P1_is_identified_by", "P1i_identifies": "crm:P1i_identifies", "P2_has_type": "crm:P2_has_type", "P4_has_time_span": "crm:P4_has_time-span", "P52_has_current_owner": "crm:P52_has_current_owner",
        "P51_has_former_or_current_owner": "crm:P51_has_former_or_current_owner", "P53_has_location": "crm:P53_has_former_or_current_location", "P128_carries": "crm:P128_carries", "P128i_is_carried_by": "crm:P128i_is_carried_by",
        "P138_represents": "crm:P138_represents", "P138i_has_representation": "crm:P138i_has_representation", "P139_has_alternative_form": "crm:P139_has_alternative_form", "P140_assigned_attribute_to": "crm:P140_assigned_attribute_to",
        "P141_assigned": "crm:P141_assigned", "P108_has_produced": "crm:P108_has_produced", "P108i_was_produced_by": "crm:P108i_was_produced_by", "contentUrl": "sdo:contentUrl", "P70i_is_documented_in": "crm:P70i_is_documented_in",
        "P72_has_language": "crm:P72_has_language", "closeMatch": "skos:closeMatch", "additionalType": "sdo:additionalType", "sameAs": "sdo:sameAs", "parentOrganization": "sdo:parentOrganization", "geometrySource": "prov:wasDerivedFrom",
        "absorbedInto": "crm:P99i_was_dissolved_by", "mergedInto": "crm:P124_transformed", "observationOf": "crm:P140_assigned_attribute_to", "wasDerivedFrom": "prov:wasDerivedFrom", "hadPrimarySource": "prov:hadPrimarySource",
    },
    "xsd:string": {
        "P7_took_place_at": "crm:P7_took_place_at", "P14_carried_out_by": "crm:P14_carried_out_by", "P50_has_current_keeper": "crm:P50_has_current_keeper", "P190_has_symbolic_content": "crm:P190_has_symbolic_content",
        "dcterms:description": "dcterms:description", "featureType": "crm:P2_has_type", "mainBodyWater": "crm:P3_has_note", "status": "crm:P2_has_type", "psurId": "crm:P1_is_identified_by", "observedLabel": "crm:P1_is_identified_by",
        "observedName": "crm:P141_assigned", "product": "crm:P141_assigned", "hasOwner": "crm:P14_carried_out_by", "hasAdministrator": "crm:P14_carried_out_by", "hasDirector": "crm:P14_carried_out_by", "locationStd": "crm:P7_took_place_at",
        "pageReference": "crm:P3_has_note", "sourceFile": "prov:hadPrimarySource", "sourceColumn": "dcterms:description", "sourceRow": "dcterms:identifier", "transformedBy": "prov:wasGeneratedBy", "modelEntity": "dcterms:conformsTo",
        "schemaTable": "dcterms:isPartOf", "linkedVia": "rdfs:comment", "labelOnMap": "crm:P190_has_symbolic_content", "mapId": "crm:P48_has_preferred_identifier",
    },
    "xsd:date": {"P82a_begin_of_the_begin": "crm:P82a_begin_of_the_begin", "P82b_end_of_the_end": "crm:P82b_end_of_the_end"},
    "xsd:gYear": {"mapYear": "crm:P4_has_time-span", "observationYear": "crm:P4_has_time-span"},
    "xsd:integer": {"fid": "crm:P48_has_preferred_identifier", "sizeAkkers": "crm:P43_has_dimension"},
    "xsd:boolean": {"deserted": "crm:P141_assigned", "hasPolygon": "geo:sfContains"},
    "xsd:dateTime": {"generatedAtTime": "prov:generatedAtTime"},
    "geo:wktLiteral": {"asWKT": "geo:asWKT"},
    "": {"hasGeometry": "geo:hasGeometry", "prefLabel": "skos:prefLabel", "altLabel": "skos:altLabel"},
}
#: Terms of what the graph's bodies hold, by class and key; keys that are not here go by their own name.
BODY_TERMS = {
    "E22": {"label": "prefLabel", "type": "P2_has_type", "carries": "P128_carries", "produced_by": "P108i_was_produced_by"},
    "E25": {"label": "prefLabel", "status": "status", "owner": "P52_has_current_owner", "former_owner": "P51_has_former_or_current_owner", "place": "P53_has_location", "identified_by": "P1_is_identified_by", "depicted_on": "P138i_has_representation"},
    "E26": {"label": "prefLabel", "type": "featureType", "main_body_water": "mainBodyWater", "place": "P53_has_location", "identified_by": "P1_is_identified_by"},
    "E74": {"label": "prefLabel", "psur": "psurId", "absorbed_into": "absorbedInto"},
    "E53": {"fid": "fid", "label": "observedLabel", "geometry": "asWKT", "source": "P70i_is_documented_in"},
    "E41": {"content": "P190_has_symbolic_content", "identifies": "P1i_identifies", "carried_by": "P128i_is_carried_by", "alternative_of": "P139_has_alternative_form"},
    "E36": {"represents": "P138_represents", "carried_by": "P128i_is_carried_by"},
    "E55": {"label": "prefLabel", "broader": "broader"},
    "E52": {"label": "prefLabel", "begin": "P82a_begin_of_the_begin", "end": "P82b_end_of_the_end"},
    "E12": {"label": "prefLabel", "produced": "P108_has_produced", "time_span": "P4_has_time_span"},
    "E13": {"about": "observationOf", "year": "observationYear", "name": "observedName", "product": "product", "deserted": "deserted", "source": "hadPrimarySource", "size": "sizeAkkers"},
}


def context() -> dict:
    """The context of a document: prefixes, and terms with their property and kind."""
    terms = {t: (p if not kind else {"@id": p, "@type": kind}) for kind, of in TERMS.items() for t, p in of.items()}
    return {"@vocab": VOCABULARY, **PREFIXES, **terms}


def full(name: str) -> str:
    """A short name as a full one."""
    prefix, _, rest = name.partition(":")
    return PREFIXES[prefix] + rest if prefix in PREFIXES else name


def _term_table() -> list[tuple[str, str, str]]:
    return [(t, full(p), full(kind)) for kind, of in TERMS.items() for t, p in of.items()]


def _mapped(key: Column, of: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[key], otherwise) if of else otherwise


def expand(nodes: DataFrame, terms: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """`id, property, kind, value, language, nth`: a row for each value of documents `id, body` (JSON with short terms).

    A list gives a row an element, in order (`nth`), a language map a row a language; numbers and booleans
    are their text. The kind is the context's: `@id` for links, a full type name, or '' for plain text. A
    term that the context does not have is in VOCABULARY. Nulls and empty lists give no row.
    """
    terms = terms or _term_table()
    of_property, of_kind = {t: p for t, p, _ in terms}, {t: k for t, _, k in terms}
    each = nodes.select("id", F.explode(F.from_json("body", "map<string,variant>")).alias("term", "v"))
    got = lambda kind: F.try_variant_get("v", "$", kind)
    one = lambda v, language: F.struct(v.alias("value"), language.alias("language"))
    none = F.lit(None).cast("string")
    listed = F.transform(got("array<string>"), lambda x: one(x, none))
    tongues = F.transform(F.array_sort(F.map_entries(got("map<string,string>"))), lambda e: one(e["value"], e["key"]))
    values = F.coalesce(listed, tongues, F.array(one(got("string"), none)))
    rows = each.select("id", "term", F.posexplode(F.filter(values, lambda x: x["value"].isNotNull())).alias("nth", "x"))
    plain = F.concat(F.lit(VOCABULARY), F.col("term"))
    return rows.select("id", _mapped(F.col("term"), of_property, plain).alias("property"), _mapped(F.col("term"), of_kind, F.lit("")).alias("kind"), "x.value", "x.language", "nth")


def compact(rows: DataFrame, terms: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """`id, body` of expanded rows: the least term for each property and kind, one value as it is, several as a list in order, languages as a map.

    A property of VOCABULARY without a term goes by its last part, any other by its full name; integers
    and booleans are written bare where they can be read as such.
    """
    terms = terms or _term_table()
    least: dict[str, str] = {}
    for t, p, k in sorted(terms, reverse=True):
        least[f"{k} {p}"] = t
    name = F.when(F.col("property").startswith(VOCABULARY), F.substr("property", F.lit(len(VOCABULARY) + 1))).otherwise(F.col("property"))
    return _bodies(rows.select("id", _mapped(F.concat_ws(" ", "kind", "property"), least, name).alias("term"), "kind", "value", "language", "nth"))


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _said(kind: Column, value: Column) -> Column:
    """A value as JSON: integers and booleans bare where they can be read as such."""
    bare = ((kind == full("xsd:integer")) & value.rlike(r"^(0|-?[1-9]\d{0,17})$")) | ((kind == full("xsd:boolean")) & value.isin("true", "false"))
    return F.when(bare, value).otherwise(_quoted(value))


def _bodies(rows: DataFrame) -> DataFrame:
    """`id, body` of rows `id, term, kind, value, language, nth`."""
    said = rows.select("id", "term", "language", "nth", _said(F.col("kind"), F.col("value")).alias("text"), _quoted(F.col("language")).alias("tongue"))
    texts = F.array_sort(F.collect_list(F.struct("nth", "text", "tongue", "language")))
    by_term = said.groupBy("id", "term").agg(texts.alias("x"))
    list_of = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["text"]), ","), F.lit("]"))
    map_of = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda x: F.concat(x["tongue"], F.lit(":"), x["text"])), ","), F.lit("}"))
    body = F.when(F.exists("x", lambda x: x["language"].isNotNull()), map_of).when(F.size("x") == 1, F.col("x")[0]["text"]).otherwise(list_of)
    pair = by_term.select("id", "term", F.concat(_quoted(F.col("term")), F.lit(":"), body).alias("pair"))
    pairs = F.array_sort(F.collect_list(F.struct("term", "pair")))
    return pair.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["pair"]), ","), F.lit("}")).alias("body"))


def documents(graph: DataFrame, path: str | None = None) -> DataFrame:
    """`id, class, body` of a graph with the context's terms in place of its own keys, and the rule of one value or a list kept.

    An entity that occurs twice is one document with the values of both, each once. One that occurs once,
    as most do, is rewritten within its row; only the others are taken apart into values and put together
    again. With `path` the graph is written there first, so it is made once.
    """
    keys = {f"{c} {k}": t for c, of in BODY_TERMS.items() for k, t in of.items()}
    kinds = {t: k for t, _, k in _term_table()}
    term_of = lambda key: _mapped(F.concat_ws(" ", F.col("class"), key), keys, key)
    values_of = lambda v: F.filter(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    read = F.from_json("body", "map<string,variant>")
    terms = F.transform(F.map_keys(read), term_of)
    alone = (F.count(F.lit(1)).over(W.partitionBy("id", "class")) == 1) & (F.size(F.array_distinct(terms)) == F.size(terms))
    told = graph.select("id", "class", "body", F.coalesce(alone, F.lit(False)).alias("alone"))
    told = told if path is None else written(told, path)

    def pair(term: Column, values: Column) -> Column:
        texts = F.transform(values, lambda x: _said(_mapped(term, kinds, F.lit("")), x))
        return F.concat(_quoted(term), F.lit(":"), F.when(F.size(values) == 1, F.array_join(texts, "")).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))))

    each = F.transform(F.map_entries(read), lambda e: F.struct(term_of(e["key"]).alias("term"), F.array_distinct(values_of(e["value"])).alias("values")))
    each = F.array_sort(F.filter(each, lambda e: F.size(e["values"]) > 0))
    pairs = F.transform(each, lambda e: pair(e["term"], e["values"]))
    body = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    # A row of one element, so that the text is made once and not for its test as well.
    one = told.filter("alone").select("id", "class", F.explode(F.filter(F.array(body), lambda b: b != "{}")).alias("body"))

    apart = told.filter("not alone").select("id", "class", F.explode(read).alias("key", "v"))
    renamed = apart.select("id", "class", term_of(F.col("key")).alias("term"), F.posexplode(values_of(F.col("v"))).alias("nth", "value"))
    rows = renamed.groupBy("id", "class", "term", "value").agg(F.min("nth").alias("nth"))
    kind = _mapped(F.col("term"), kinds, F.lit(""))
    many = _bodies(rows.select(F.struct("id", "class").alias("id"), "term", kind.alias("kind"), "value", F.lit(None).cast("string").alias("language"), "nth")).select("id.id", "id.class", "body")
    return one.unionByName(many)
