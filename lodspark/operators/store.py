"""Changes to a record store: each takes the table and a table of requests, and returns the new table or the outcomes.

Requests carry `actor` and `at`; nothing reads a clock, so a change can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodspark.functions.text import slug_capped

from .dedupe import in_sequence
from .gazetteer import crm_class


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with rows of `new` in place of, or beside, its own. `new` has a key once."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def overlay(table: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`table` with the fields that a patch names; a patch is key, `fields` and `has` (names of the fields it sets, to null too)."""
    p = patch.select(F.col(key), F.col("has"), *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = table.join(p, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.array_contains(F.coalesce("has", F.array().cast("array<string>")), f), F.col(f"new_{f}")).otherwise(F.col(f)))
    return joined.select(table.columns)


def outcome(found: Column, merged: Column, deprecated: Column, ok: str = "200") -> Column:
    """Status of a retirement: 404 unknown, 409 merged or retired before."""
    return F.when(~found, "404").when(merged | deprecated, "409").otherwise(ok)


def one_a_key(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of the requests of a batch for one key: the first by `at` (then by a hash of the request), and `key, status` 409 for each of the others."""
    order = F.struct(F.col("at").isNull(), "at", F.xxhash64(F.to_json(F.struct(*requests.columns))))
    g = requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), order).alias("r"), F.count(F.lit(1)).cast("int").alias("n"))
    others = g.filter("n > 1").select(key, F.explode(F.array_repeat(F.lit("409"), F.col("n") - 1)).alias("status"))
    return g.select("r.*"), others


def tombstone(table: DataFrame, requests: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Retire records: the new table, and `key, status` of each request. Rows are never removed. Table: deprecated, merged_into, deprecated_by, deprecated_at, note.

    Of several requests for a record in one batch the first is judged, the others get 409.
    """
    first, others = one_a_key(requests, key)
    req = first.select(key, "actor", "at", F.trim("note").alias("why"))
    met = req.join(table.select(key, "deprecated", "merged_into").withColumn("there", F.lit(True)), key, "left")
    status = outcome(F.coalesce("there", F.lit(False)), F.col("merged_into").isNotNull(), F.coalesce("deprecated", F.lit(False)))
    judged = met.select(key, "actor", "at", "why", status.alias("status"))
    done = judged.filter("status = '200'").drop("status").withColumn("hit", F.lit(True))
    new = table.join(done, key, "left")
    for column, value in (("deprecated", F.lit(True)), ("deprecated_by", F.col("actor")), ("deprecated_at", F.col("at")), ("note", F.nullif("why", F.lit("")))):
        new = new.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column)))
    return new.select(table.columns), judged.select(key, "status").unionByName(others)


def merge(table: DataFrame, requests: DataFrame, key: str = "id", kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge pairs (`keep`, `retire`, and `at` where requests have an order): the retired record points to the kept one, which is replaced by its row in `kept`, if it has one there.

    Outcomes: 400 equal or missing ids or one merged before, 404 unknown, 409 for a pair that meets an
    earlier valid one of the batch - it names a record that was to be retired, or would retire one that was to
    be kept - and can be sent again once that one is decided. Valid is what the table alone allows: an
    earlier pair that is itself refused with 409 blocks as well, so of (1, 2), (2, 3), (3, 4) the first is
    done and both others are refused. So a batch is judged in one pass and never makes a chain.
    """
    state = table.select(F.col(key).alias("k"), F.col("merged_into").isNotNull().alias("gone"))
    at = F.col("at") if "at" in requests.columns else F.lit(None).cast("string")
    r = requests.select("keep", "retire", F.struct(at.isNull().alias("late"), at.alias("at"), "keep", "retire").alias("turn"))
    r = r.groupBy("keep", "retire").agg(F.min("turn").alias("turn"), F.count(F.lit(1)).cast("int").alias("n"))
    for c in ("keep", "retire"):
        r = r.join(state.select(F.col("k").alias(c), F.col("gone").alias(f"{c}_gone")), c, "left")
    alone = F.when(F.coalesce(F.col("keep") == F.col("retire"), F.lit(True)), "400").when(F.col("keep_gone").isNull() | F.col("retire_gone").isNull(), "404").when(F.col("keep_gone") | F.col("retire_gone"), "400")
    r = r.withColumn("alone", alone)
    fit = r.filter("alone is null")
    retired, held = (fit.groupBy(F.col(c).alias("k")).agg(F.min("turn").alias("first")) for c in ("retire", "keep"))
    for name, column, of in (("keep_retired", "keep", retired), ("retire_retired", "retire", retired), ("retire_held", "retire", held)):
        r = r.join(of.select(F.col("k").alias(column), F.col("first").alias(name)), column, "left")
    earlier = [F.coalesce(F.col(c) < F.col("turn"), F.lit(False)) for c in ("keep_retired", "retire_retired", "retire_held")]
    judged = r.select("keep", "retire", "n", F.coalesce("alone", F.when(earlier[0] | earlier[1] | earlier[2], "409").otherwise("200")).alias("status"))
    done = judged.filter("status = '200'")
    again = judged.filter("n > 1").select("keep", "retire", F.explode(F.array_repeat(F.lit("409"), F.col("n") - 1)).alias("status"))
    into = done.select(F.col("retire").alias(key), F.col("keep").alias("into"))
    new = table
    if kept is not None:
        new = replace_by_key(table, kept.join(done.select(F.col("keep").alias(key)).distinct(), key, "left_semi"), key)
    new = new.join(into, key, "left").withColumn("merged_into", F.coalesce("into", "merged_into")).select(table.columns)
    return new, judged.select("keep", "retire", "status").unionByName(again)


_LINKED = "wikidata"


def derived(places: DataFrame, actor: Column | None = None, at: Column | None = None) -> DataFrame:
    """Places with what follows from their other fields: `qid` from the first Wikidata link, `crm_class` from the type, and stamps where given."""
    links = F.coalesce("external_links", F.slice("external_links", 1, 0))
    qid = F.get(F.filter(links, lambda x: x["authority"] == _LINKED), F.lit(0))["identifier"]
    out = places.withColumn("qid", qid).withColumn("crm_class", crm_class(F.col("type")))
    if actor is not None:
        out = out.withColumn("modified_by", actor).withColumn("modified_at", at)
    return out


def save_places(places: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add or replace whole places (`requests`: the places' columns, and `actor`, `at`): the new table and `id, status`.

    400 without id, names or type; 409 for all but the first request for an id; 201 added, 200 replaced.
    Places: id, names, type, external_links, qid, crm_class, modified_by, modified_at and any others;
    what a request does not give is null in the new record.
    """
    complete = (F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) != "") & (F.coalesce(F.size("names"), F.lit(0)) > 0) & (F.coalesce(F.trim("type"), F.lit("")) != "")
    marked = requests.withColumn("complete", F.coalesce(complete, F.lit(False)))
    first, others = one_a_key(marked.filter("complete"), "id")
    known = places.select("id").withColumn("there", F.lit(True))
    judged = first.select("id").join(known, "id", "left").select("id", F.when(F.col("there"), "200").otherwise("201").alias("status"))
    refused = marked.filter("not complete").select("id", F.lit("400").alias("status"))
    made = derived(first, F.col("actor"), F.col("at"))
    made = made.select(*[(F.col(c) if c in made.columns else F.lit(None).cast(places.schema[c].dataType)).alias(c) for c in places.columns])
    return replace_by_key(places, made, "id"), judged.unionByName(others).unionByName(refused)


def patch_places(places: DataFrame, patches: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set the fields that patches name (`has`) and recompute what follows from them: the new table and `id, status`.

    400 without id, 404 unknown, 409 for all but the first patch for an id, 200 done. Each place stays one
    row: those that share an id are all patched, those without one never.
    """
    first, others = one_a_key(patches.filter("id is not null"), "id")
    judged = first.select("id").join(places.select("id").withColumn("there", F.lit(True)), "id", "left").select("id", F.when(F.col("there"), "200").otherwise("404").alias("status"))
    refused = patches.filter("id is null").select("id", F.lit("400").alias("status"))
    # The places and their patches side by side: what was there before needs no second look.
    met = places.select(F.struct(*places.columns).alias("_before"), "id").join(first.select("id", F.struct(*first.columns).alias("_patch")), "id", "left")
    sets = lambda f: F.coalesce(F.array_contains(F.col("_patch.has"), f), F.lit(False))
    new = met.select("_before", "_patch", *[(F.when(sets(c), F.col(f"_patch.{c}")).otherwise(F.col(f"_before.{c}")) if c in fields else F.col(f"_before.{c}")).alias(c) for c in places.columns])
    new = derived(new, F.col("_patch.actor"), F.col("_patch.at"))
    out = new.select(*[F.when(F.col("_patch").isNotNull(), F.col(c)).otherwise(F.col(f"_before.{c}")).alias(c) for c in places.columns])
    return out, judged.unionByName(others).unionByName(refused)


def patch_rows(table: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set the fields that patches name (`key, has`, the fields, `actor`, `at`), to null too, and `modified_by`, `modified_at` where the table has them: the new table and `key, status`.

    For sources, concepts and entries alike. 400 without a key, or with no field that may be set; 404
    unknown; 409 for all but the first patch for a key; 200 done. Fields that may not be set are passed
    over. Each row of the table stays one row.
    """
    named = F.array_intersect(F.coalesce("has", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]))
    marked = patches.withColumn("has", named).withColumn("fit", F.col(key).isNotNull() & (F.size("has") > 0))
    first, others = one_a_key(marked.filter("fit").drop("fit"), key)
    met = table.select(F.struct(*table.columns).alias("_row"), F.col(key)).join(first.select(key, F.struct(*first.columns).alias("_patch")), key, "left")
    stamps = {"modified_by": "actor", "modified_at": "at"}
    sets = lambda f: F.coalesce(F.array_contains("_patch.has", f), F.lit(False))
    hit = F.col("_patch").isNotNull()
    out = [F.when(sets(c), F.col(f"_patch.{c}")).otherwise(F.col(f"_row.{c}")).alias(c) if c in fields else F.when(hit, F.col(f"_patch.{stamps[c]}")).otherwise(F.col(f"_row.{c}")).alias(c) if c in stamps else F.col(f"_row.{c}").alias(c) for c in table.columns]
    known = table.select(key).distinct().withColumn("there", F.lit(True))
    judged = first.select(key).join(known, key, "left").select(key, F.when(F.col("there"), "200").otherwise("404").alias("status"))
    return met.select(*out), judged.unionByName(others).unionByName(marked.filter("not fit").select(key, F.lit("400").alias("status")))


def create_concepts(concepts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add concepts: the new thesaurus and `type, status`.

    Requests: type, labels (language to label), at, and any of the concepts' columns; what they do not give
    is null, `sort_order` of concepts without one is 99. 400 without a type or an English label; 409 for a
    type that is taken, retired or not, and for all but the first request for it; 201 added.
    """
    clean = requests.withColumn("type", F.nullif(F.trim("type"), F.lit("")))
    fit = F.col("type").isNotNull() & (F.coalesce(F.trim(F.col("labels")["en"]), F.lit("")) != "")
    marked = clean.withColumn("fit", F.coalesce(fit, F.lit(False)))
    asked = marked.filter("fit").drop("fit").withColumn("labels", F.map_filter("labels", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    # A map has no order: requests are compared by their text.
    told = asked.withColumn("labels", F.to_json("labels"))
    first, others = one_a_key(told, "type")
    known = concepts.select("type").distinct().withColumn("there", F.lit(True))
    met = first.join(known, "type", "left").withColumn("status", F.when(F.col("there"), "409").otherwise("201"))
    made = met.filter("status = '201'").withColumn("labels", F.from_json("labels", "map<string,string>"))
    values = {"sort_order": F.coalesce("sort_order", F.lit(99)) if "sort_order" in made.columns else F.lit(99)}
    new = made.select(*[(values[c] if c in values else F.col(c) if c in made.columns else F.lit(None)).cast(concepts.schema[c].dataType).alias(c) for c in concepts.columns])
    return concepts.unionByName(new), met.select("type", "status").unionByName(others).unionByName(marked.filter("not fit").select("type", F.lit("400").alias("status")))


def replace_thesaurus(concepts: DataFrame, new: DataFrame, context: str | None) -> tuple[DataFrame, str]:
    """A whole thesaurus in place of another: what is kept, and the status.

    400, and the old one stays, without a context, without any concept, or if a concept has no type or two
    have one; 200 else. Columns are those of the old one; what the new one does not give is null.
    """
    at = new.agg(F.count(F.lit(1)).alias("n"), F.count("type").alias("known"), F.countDistinct("type").alias("types")).first()
    if not (context or "").strip() or not at["n"] or not at["n"] == at["known"] == at["types"]:
        return concepts, "400"
    return new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(concepts.schema[c].dataType).alias(c) for c in concepts.columns]), "200"


def save_sources(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add sources to a registry, after its last category, or update their editable fields: the new registry in order (`pos` anew) and `source_id, status`.

    Registry: pos, kind (`category` or `source`), source_id, category, label, description, linked.
    Requests: source_id (null: new), category, label, description, linked, at. 400 without label or category; 409 for a new
    source whose id (its label's slug, 60 characters at most) is taken, and for all but the first
    request for an id; 201 added, 200 updated. Of new sources the last one stands first.
    """
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = requests.select(clean("source_id").alias("given"), clean("category").alias("category"), clean("label").alias("label"), clean("description").alias("description"), "linked", "at")
    r = r.withColumn("source_id", F.coalesce("given", slug_capped("label")))
    refused = r.filter("label is null or category is null").select("source_id", F.lit("400").alias("status"))
    first, others = one_a_key(r.filter("label is not null and category is not null"), "source_id")
    known = registry.filter("kind = 'source'").select("source_id").distinct().withColumn("there", F.lit(True))
    met = first.join(known, "source_id", "left").withColumn("status", F.when(F.col("there") & F.col("given").isNull(), "409").when(F.col("there"), "200").otherwise("201"))
    fields = ["category", "label", "description", "linked"]
    update = met.filter("status = '200'").select("source_id", F.struct(*fields).alias("u"))
    old = registry.join(update, "source_id", "left")
    hit = F.col("u").isNotNull() & (F.col("kind") == "source")
    old = old.select(*[(F.when(hit, F.col(f"u.{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c) for c in registry.columns])
    last = registry.filter("kind = 'category'").agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last")).first()["last"]
    added = met.filter("status = '201'")
    newest = in_sequence([added.withColumn("turn", F.unix_micros(F.to_timestamp("at")))], "turn")
    added = newest.select((-F.col("seq")).alias("pos"), F.lit("source").alias("kind"), "source_id", *fields)
    rows = in_sequence([old.filter(F.col("pos") <= last), added.select(registry.columns), old.filter(F.col("pos") > last)])
    new = rows.withColumn("pos", F.col("seq") - 1).select(registry.columns)
    return new, met.select("source_id", "status").unionByName(others).unionByName(refused)


def retire_concepts(concepts: DataFrame, places: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retire types of a thesaurus: the new thesaurus and `type, status`.

    Concepts: type, deprecated, deprecated_at, deprecated_by, replaced_by, deprecation_note, history_note.
    Requests: type, replaced_by, note, actor, at. 400 without type; 409 if active places use it and nothing replaces
    it, if it is retired already, or another request of the batch came first; 404 unknown; 200 done.
    """
    first, others = one_a_key(requests.filter("type is not null"), "type")
    refused = requests.filter("type is null").select("type", F.lit("400").alias("status"))
    used = places.filter(~F.coalesce("deprecated", F.lit(False)) & F.col("merged_into").isNull()).groupBy("type").agg(F.count("type").alias("n_active"))
    known = concepts.select("type", F.coalesce("deprecated", F.lit(False)).alias("gone"))
    met = first.select("type", F.nullif(F.trim("replaced_by"), F.lit("")).alias("by"), F.nullif(F.trim("note"), F.lit("")).alias("why"), "actor", "at").join(known, "type", "left").join(used, "type", "left")
    status = F.when((F.coalesce("n_active", F.lit(0)) > 0) & F.col("by").isNull(), "409").when(F.col("gone").isNull(), "404").when(F.col("gone"), "409").otherwise("200")
    judged = met.withColumn("status", status)
    done = judged.filter("status = '200'").select("type", F.struct("by", "why", "actor", "at").alias("r"))
    hit, said = F.col("r").isNotNull(), F.concat(F.lit("Deprecated "), F.col("r.at"), F.lit(" by "), F.col("r.actor"), F.lit("."), F.coalesce(F.concat(F.lit(" Replaced by: "), F.col("r.by"), F.lit(".")), F.lit("")))
    values = {
        "deprecated": F.lit(True), "deprecated_at": F.col("r.at"), "deprecated_by": F.col("r.actor"), "replaced_by": F.coalesce("r.by", "replaced_by"),
        "deprecation_note": F.coalesce("r.why", "deprecation_note"), "history_note": F.concat_ws(" | ", F.nullif("history_note", F.lit("")), said),
    }
    new = concepts.join(done, "type", "left").select(*[(F.when(hit, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in concepts.columns])
    return new, judged.select("type", "status").unionByName(others).unionByName(refused)


def type_guard(types: DataFrame, places: DataFrame, requests: DataFrame) -> DataFrame:
    """`type, status`: a concept in use by active places is not retired without a replacement (409). Requests: type, replaced_by."""
    used = places.filter(~F.coalesce("deprecated", F.lit(False)) & F.col("merged_into").isNull()).groupBy("type").agg(F.count("type").alias("n_active"))
    met = requests.join(types.select("type").withColumn("there", F.lit(True)), "type", "left").join(used, "type", "left")
    n = F.coalesce("n_active", F.lit(0))
    status = F.when(F.col("there").isNull(), "404").when((n > 0) & F.col("replaced_by").isNull(), "409").otherwise("200")
    return met.select("type", n.alias("n_active"), status.alias("status"))
