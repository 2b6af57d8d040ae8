"""Queries on lookups, matching, facets, graphs and changes of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import detail, graph, matching, placequery, store

from .tables import customer_tags, table


def _star(s, d):
    c, n, r, o, li = (table(s, d, x) for x in ("customer", "nation", "region", "orders", "lineitem"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    facts = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"), F.round(F.coalesce(F.sum("quantity"), F.lit(0.0)), 2).alias("quantity"), F.max("o_orderdate").alias("last_order"))
    out = detail.star(c, "c_custkey", [(n, "n_nationkey", "c_nationkey"), (r, "r_regionkey", "n_regionkey")], facts, ["n_orders", "n_lines"])
    return out.select("c_custkey", "c_name", "n_name", "r_name", "n_orders", "n_lines", "quantity", "last_order")


def _or_key(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    keys = [F.concat(F.lit("id:"), F.col("c_custkey").cast("string")), F.concat(F.lit("name:"), "c_name"), F.concat(F.lit("seg:"), "c_mktsegment")]
    wanted = table(s, d, "orders").select(F.explode(F.array(F.concat(F.lit("id:"), F.col("o_custkey").cast("string")), F.lit("seg:BUILDING"), F.lit("name:none"))).alias("key")).distinct()
    return matching.any_key(c, keys, wanted, "c_custkey").select("key", "c_custkey")


def _two_keys(s, d):
    sup = table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("k1"), F.col("s_nationkey").alias("k2"), F.col("s_name").alias("found"), F.col("s_suppkey").alias("pos"))
    li = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 150).alias("k1"), (F.col("p_partkey") % 40).cast("int").alias("k2"))
    return matching.two_keys(li, sup, "k1", "k2", "found").select("p_partkey", "found")


def _ambiguous(s, d):
    p = table(s, d, "part")
    known = p.filter("p_partkey % 2 = 0").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("target"))
    items = p.filter("p_partkey % 2 = 1").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("item"))
    return matching.ambiguous(items, known, ["name"], "target").select("name", "item", "match", "outcome")


def _anti(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return detail.without(table(s, d, "customer"), o, "c_custkey").select("c_custkey", "c_name")


def _anti_conditional(s, d):
    p = table(s, d, "part")
    known = p.filter("p_size < 10").select(F.col("p_name").alias("label"))
    rows = p.select("p_partkey", F.col("p_name").alias("label"), "p_size")
    return matching.drop_if_known(rows, F.col("p_size") > 25, "label", known).select("p_partkey", "p_size")


def _categories(s, d):
    n = table(s, d, "nation")
    c = table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return detail.category_counts(n, c, "n_nationkey", n=F.col("c_acctbal") > 9000, n_building=F.col("c_mktsegment") == "BUILDING").select("n_name", "n", "n_building")


def _tree(s, d):
    """Concepts under their top concepts."""
    r = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("broader"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("broader"))
    u = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("broader"))
    return graph.tree(r.unionByName(n).unionByName(u))


def _defaults(s, d):
    lookup = s.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment string, sort int")
    return matching.default_lookup(table(s, d, "customer").select("c_custkey", "c_mktsegment"), lookup, "c_mktsegment", "sort", 99).select("c_custkey", "sort")


def _facet(mode, selected, exclude=None):
    def run(s, d):
        t = customer_tags(s, d)
        return t.filter(placequery.facet(F.col("tags"), selected, mode, exclude)).select("custkey")

    return run


def _tombstones(s, d):
    c = table(s, d, "orders").select((F.col("o_orderstatus") == "P").alias("deprecated"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("x")).alias("merged_into"))
    return c.agg(
        F.count_if(F.col("deprecated")).alias("n_deprecated"),
        F.count_if(F.col("merged_into").isNotNull()).alias("n_merged"),
        F.count_if(placequery.visible(F.col("deprecated"), F.col("merged_into"))).alias("n_visible"),
        F.count_if(placequery.visible(F.col("deprecated"), F.col("merged_into"), True)).alias("n_with_merged"),
    )


def _sorted(s, d):
    from pyspark.sql import Window as W

    c = table(s, d, "customer").withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    w = W.partitionBy("c_nationkey").orderBy(placequery.order(F.col("bal"), True), "c_custkey")
    return c.select("c_custkey", "c_nationkey", F.row_number().over(w).alias("place"))


def _arrays(s, d):
    o = table(s, d, "orders")
    half = lambda r: o.filter(F.col("o_orderkey") % 2 == r).groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias(f"t{r}"))
    both = half(0).join(half(1), "o_custkey", "full")
    empty = F.array().cast("array<string>")
    joined = matching.union_distinct(F.coalesce("t0", empty), F.coalesce("t1", empty), F.array(F.lit("5-LOW")))
    return both.select("o_custkey", F.array_join(F.array_sort(joined), ",").alias("tags"))


def _keyed_union(s, d):
    p = table(s, d, "part")
    side = lambda rows: rows.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).select(F.concat_ws(" ", "p_brand", "p_name").alias("p_name"), "p_partkey")
    return matching.keyed_union(side(p.filter("p_size <= 25")), side(p.filter("p_size > 25")), "p_name")


def _origin(s, d):
    p = table(s, d, "part")
    p = p.select(F.concat_ws(" ", "p_brand", "p_name").alias("p_name"), "p_size")
    return matching.origin(p.filter("p_size <= 3"), p.filter("p_size > 3"), "p_name").select("key", "origin")


def _graph(s, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(s, d, "region").select(*graph.entity("E55", text("type/", "r_regionkey"), label=F.col("r_name"))),
        table(s, d, "nation").select(*graph.entity("E53", text("place/", "n_nationkey"), label=F.col("n_name"), within=text("type/", "n_regionkey"))),
        table(s, d, "customer").select(*graph.entity("E74", text("org/", "c_custkey"), label=F.col("c_name"), at=text("place/", "c_nationkey"))),
        table(s, d, "supplier").select(*graph.entity("E25", text("feature/", "s_suppkey"), label=F.col("s_name"), at=text("place/", "s_nationkey"))),
        table(s, d, "orders").select(*graph.entity("E13", text("obs/", "o_orderkey"), about=text("org/", "o_custkey"))),
        table(s, d, "part").select(*graph.entity("E41", text("name/", "p_partkey"), text=F.col("p_name"))),
    ]
    return graph.union_all(parts)


def _report(s, d):
    c = table(s, d, "customer")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("seen").isNotNull()).alias("with_observation"),
        F.count_if(F.col("n_name").isNotNull()).alias("with_place"),
        F.count_if(F.col("c_acctbal") < 0).alias("negative"),
        F.round(F.count_if(F.col("seen").isNotNull()) / F.count(F.lit(1)), 6).alias("observed_share"),
    )


def _coverage(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" ").alias("segment"))
    return graph.coverage(c, ["c_custkey", "balance", "segment"]).select("column_name", "present", "total", F.round("share", 6).alias("share"))


def _unlinked(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return detail.unlinked_percent(table(s, d, "orders"), li, "o_orderkey").select(F.col("percent").alias("unlinked_pct"))


def _roles(s, d):
    """Flag columns of each line as role rows."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = li.unpivot(["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"], "role", "value")
    return rows.groupBy("role", "value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


def _provenance(s, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = graph.union_all([
        table(s, d, "orders").select(text("o", "o_orderkey").alias("src"), text("c", "o_custkey").alias("dst")),
        table(s, d, "customer").select(text("c", "c_custkey").alias("src"), text("n", "c_nationkey").alias("dst")),
        table(s, d, "nation").select(text("n", "n_nationkey").alias("src"), text("r", "n_regionkey").alias("dst")),
    ])
    # Every node has one edge, so walks are as many as the nodes that they start from.
    return graph.walk_counts(edges, 3).filter(F.col("dst").startswith("r"))


def _provenance_of_lines(s, d):
    """Walks of up to four hops from line to order, customer, nation and region."""
    text = lambda p, *c: F.concat(F.lit(p), F.concat_ws("-", *c))
    edges = graph.union_all([
        table(s, d, "lineitem").select(text("l", "l_orderkey", "l_linenumber").alias("src"), text("o", "l_orderkey").alias("dst")),
        table(s, d, "orders").select(text("o", "o_orderkey").alias("src"), text("c", "o_custkey").alias("dst")),
        table(s, d, "customer").select(text("c", "c_custkey").alias("src"), text("n", "c_nationkey").alias("dst")),
        table(s, d, "nation").select(text("n", "n_nationkey").alias("src"), text("r", "n_regionkey").alias("dst")),
    ])
    return graph.walk_counts(edges, 4).filter(F.col("dst").startswith("r"))


def _places(s, d):
    return table(s, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("size"), (F.col("s_suppkey") % 10 == 3).alias("deprecated"),
        F.when(F.col("s_suppkey") % 10 == 4, F.col("s_suppkey") - 1).alias("merged_into"), F.lit(None).cast("string").alias("deprecated_by"), F.lit(None).cast("string").alias("deprecated_at"), F.lit(None).cast("string").alias("note"),
    )


def _upsert(s, d):
    places = _places(s, d).select("id", "label")
    new = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("new "), "p_name").alias("label"))
    return store.replace_by_key(places, new, "id")


def _patch(s, d):
    patch = _places(s, d).select("id", F.array(F.when(F.col("id") % 2 == 0, "label").otherwise("size")).alias("has"), F.when(F.col("id") % 4 == 0, F.lit("patched")).alias("label"), F.lit(0.0).alias("size"))
    return store.overlay(_places(s, d).select("id", "label", "size"), patch, "id", ["label", "size"])


def _guard(s, d):
    places = table(s, d, "customer").select(F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") < 0).alias("deprecated"), F.lit(None).cast("string").alias("merged_into"))
    types = places.select("type").distinct().unionByName(s.createDataFrame([("UNUSED",)], "type string"))
    named = types.unionByName(table(s, d, "part").select(F.col("p_brand").alias("type")).distinct())
    requests = named.withColumn("replaced_by", F.when(F.col("type") == "MACHINERY", "BUILDING"))
    return store.type_guard(types, places, requests)


def _by_entity(s, d):
    return detail.summaries(table(s, d, "part"), "p_brand", first_name=F.min("p_name"), last_name=F.max("p_name"), n_names=F.countDistinct("p_name"))


def _by_org(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "custkey")
    return detail.summaries(o, "custkey", first_year=F.year(F.min("o_orderdate")), last_year=F.year(F.max("o_orderdate")))


def _bridge(s, d):
    """Two datasets by their shared id, and how many rows of each have it."""
    a, b = table(s, d, "customer").select("c_nationkey"), table(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return detail.bridge(a, b, "c_nationkey", ("n_customers", "n_suppliers"))


def _records(s, d):
    """Suppliers as places with names and links."""
    sup = table(s, d, "supplier")
    link = F.struct(F.when(F.col("s_suppkey") % 3 == 0, F.lit("wikidata")).otherwise("geonames").alias("authority"), F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("identifier"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("s_nationkey") % 2 == 0, "river").otherwise("plantation")
    rows = sup.select(F.col("s_suppkey").alias("id"), F.array("s_name").alias("names"), kind.alias("type"), F.array(link).alias("external_links"), none.alias("modified_by"), none.alias("modified_at"))
    return store.derived(rows)


def _save(s, d):
    """Every part is a request to save a place; parts of one number modulo the suppliers' range meet."""
    link = F.struct(F.lit("wikidata").alias("authority"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("identifier"))
    names = F.when(F.col("p_size") > 5, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    r = table(s, d, "part").select((F.col("p_partkey") % 1500).alias("id"), names.alias("names"), F.lit("district").alias("type"), F.array(link).alias("external_links"), F.lit("editor").alias("actor"), F.col("p_partkey").cast("string").alias("at"))
    new, judged = store.save_places(_records(s, d), r)
    outcomes = judged.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("status")), ",").alias("statuses"))
    return new.join(outcomes, "id", "full").select("id", F.element_at("names", 1).alias("name"), "type", "qid", "crm_class", "modified_by", "modified_at", "statuses")


def _patch_records(s, d):
    """Every customer patches the place of its number: a type, or its links."""
    links = F.when(F.col("c_custkey") % 4 == 0, F.array(F.struct(F.lit("wikidata").alias("authority"), F.lit("Q0").alias("identifier"))))
    has = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("external_links"))).otherwise(F.array(F.lit("type")))
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), has.alias("has"), F.lit("district").alias("type"), links.alias("external_links"), F.lit("editor").alias("actor"), F.lit("2024").alias("at"))
    new, judged = store.patch_places(_records(s, d), p, ["type", "external_links"])
    return new.join(judged, "id", "full").select("id", "type", F.coalesce(F.size("external_links"), F.lit(-1)).alias("n_links"), "qid", "crm_class", "modified_by", "status")


def _save_sources(s, d):
    """Nations are sources under regions; each part's brand asks for a source, each supplier updates one of its nation."""
    slug = F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))
    cats = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.lit("category").alias("kind"), F.lit(None).cast("string").alias("source_id"), F.col("r_name").alias("category"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("linked"))
    old = table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("pos"), F.lit("source").alias("kind"), slug.alias("source_id"), F.col("n_regionkey").cast("string").alias("category"), F.col("n_name").alias("label"), F.lit("old").alias("description"), F.lit(False).alias("linked"))
    day = lambda k: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd")
    brands = table(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(F.lit(None).cast("string").alias("source_id"), F.lit("x").alias("category"), F.col("p_brand").alias("label"), F.lit(" ").alias("description"), F.lit(True).alias("linked"), day(F.col("k")).alias("at"))
    named = table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, slug).alias("source_id"), F.when(F.col("n_nationkey") % 5 != 0, F.lit("y")).alias("category"), F.col("n_name").alias("label"), F.lit(" new ").alias("description"), F.lit(True).alias("linked"), day(F.col("n_nationkey")).alias("at"))
    new, judged = store.save_sources(cats.unionByName(old), brands.unionByName(named))
    return new.filter("kind = 'source'").join(judged, "source_id", "full").select("source_id", "pos", "category", "description", "linked", "status")


def _retire_types(s, d):
    """Every segment and brand is asked to retire; segments that places use need a replacement."""
    none = F.lit(None).cast("string")
    types = table(s, d, "customer").select(F.col("c_mktsegment").alias("type")).union(table(s, d, "part").select("p_brand")).distinct()
    concepts = types.select("type", (F.col("type") == "Brand#11").alias("deprecated"), none.alias("deprecated_at"), none.alias("deprecated_by"), none.alias("replaced_by"), none.alias("deprecation_note"), F.when(F.col("type") < "C", F.lit("older")).alias("history_note"))
    places = table(s, d, "customer").select(F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") < 0).alias("deprecated"), none.alias("merged_into"))
    asked = types.union(s.createDataFrame([("unknown",)], "type string")).select("type", F.when(F.col("type").isin("BUILDING", "Brand#12"), F.lit("HOUSEHOLD")).alias("replaced_by"), F.lit(" why ").alias("note"), F.lit("me").alias("actor"), F.lit("2024-01-01").alias("at"))
    new, judged = store.retire_concepts(concepts, places, asked)
    return new.join(judged, "type", "full").select("type", "deprecated", "replaced_by", "deprecation_note", "history_note", "status")


def _tombstone_all(s, d):
    """Every order asks to retire the place of its customer's number."""
    r = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("editor").alias("actor"), F.col("o_orderkey").cast("long").alias("at"), F.lpad(F.col("o_orderkey").cast("string"), 3, " ").alias("note"))
    new, judged = store.tombstone(_places(s, d).withColumn("deprecated_at", F.lit(None).cast("long")), r)
    outcomes = judged.groupBy("id").agg(F.count_if(F.col("status") == "200").alias("n_200"), F.count_if(F.col("status") == "404").alias("n_404"), F.count_if(F.col("status") == "409").alias("n_409"))
    return new.join(outcomes, "id", "full").select("id", "deprecated", "deprecated_by", "deprecated_at", "note", "n_200", "n_404", "n_409")


def _merge_all(s, d):
    """Every part asks to merge the place of one number into that of another."""
    r = table(s, d, "part").select((F.col("p_partkey") % 97 + 1).alias("keep"), (F.col("p_partkey") % 89 + 1).alias("retire"), F.col("p_partkey").cast("long").alias("at"))
    kept = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("kept "), "s_name").alias("label"))
    places = _places(s, d).select("id", "label", "merged_into")
    new, judged = store.merge(places, r, kept=kept.withColumn("merged_into", F.lit(None).cast("long")))
    done = judged.groupBy(F.col("retire").alias("id")).agg(F.sum(F.when(F.col("status") == "200", F.col("keep"))).alias("into"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "200").alias("n_done"))
    return new.join(done, "id", "full").select("id", "label", "merged_into", "into", "n", "n_done")


def _valid(s, d):
    """Which priority each customer's orders had from when to when, and what held at the start of 2000."""
    e = table(s, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderpriority").alias("priority"))
    spans = detail.validity_of(e, "o_custkey", "priority", "o_orderdate")
    at = F.lit("2000-01-01").cast("timestamp")
    return spans.join(detail.valid_links(spans, at).select("src", "valid_from", F.lit(True).alias("held")), ["src", "valid_from"], "left").select("src", "dst", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), F.coalesce("held", F.lit(False)).alias("held"))


def _gate(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    known = table(s, d, "supplier").filter("s_acctbal > 0")
    return detail.existing_only(li, known, "s_suppkey").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


_PLACES = """places AS (SELECT s_suppkey AS id, s_name AS label, s_acctbal AS size, s_suppkey % 10 = 3 AS deprecated,
  CASE WHEN s_suppkey % 10 = 4 THEN s_suppkey - 1 END AS merged_into FROM supplier)"""
_TAGS = "WITH t AS (SELECT o_custkey AS custkey, list(DISTINCT o_orderpriority) AS tags FROM orders GROUP BY o_custkey)"

def _gathered(s, d):
    """Names of the suppliers that a customer may mean by any of three links, with the nation that names them."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("c_custkey")
    c = table(s, d, "customer").select("c_custkey", text("s", key % 130).alias("a"), F.when(key % 3 == 0, text("t", key % 7)).alias("b"), text("s", F.floor(key / 20)).alias("c"))
    v = table(s, d, "supplier").select(F.explode(F.array(text("s", F.col("s_suppkey")), text("t", F.col("s_suppkey") % 11))).alias("identifies"), text("name/", F.col("s_suppkey") % 60).alias("uri"), F.col("s_name").alias("text"), text("n", F.col("s_nationkey")).alias("carried_by"), F.col("s_suppkey").alias("pos"))
    n = table(s, d, "nation").filter("n_nationkey < 20").select(text("n", F.col("n_nationkey")).alias("uri"), F.col("n_name").alias("label"))
    return detail.gathered(c, "c_custkey", ["a", "b", "c"], v, n)


def _across(s, d):
    """Types of parts by brand, as two maps of the parts show them."""
    p = table(s, d, "part").select("p_brand", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("map"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"))
    return detail.across(p, "p_brand", "map", "p_type", {"on_even": "even", "on_odd": "odd"})


QUERIES = {
    "candidate_names": _gathered,
    "names_across_maps": _across,
    "star_detail": _star,
    "or_key_lookup": _or_key,
    "coalesce_two_keys": _two_keys,
    "ambiguous_match": _ambiguous,
    "anti_orgs": _anti,
    "anti_conditional": _anti_conditional,
    "category_left_outer": _categories,
    "concept_tree": _tree,
    "type_lookup_default": _defaults,
    "facet_and": _facet("and", ["1-URGENT", "5-LOW"]),
    "facet_or": _facet("or", ["1-URGENT", "5-LOW"]),
    "facet_not": _facet("or", [], ["2-HIGH"]),
    "tombstone_view": _tombstones,
    "sort_nulls_last_desc": _sorted,
    "array_union_distinct": _arrays,
    "keyed_union": _keyed_union,
    "name_merge_origin": _origin,
    "graph_union_counts": lambda s, d: graph.class_counts(_graph(s, d)),
    "graph_entities": _graph,
    "appellations_by_entity": _by_entity,
    "observations_by_org": _by_org,
    "validation_report": _report,
    "column_coverage": _coverage,
    "unlinked_pct": _unlinked,
    "role_unpivot": _roles,
    "provenance_depth": _provenance,
    "provenance_depth_lines": _provenance_of_lines,
    "upsert_places": _upsert,
    "patch_places": _patch,
    "active_type_guard": _guard,
    "dataset_bridge": _bridge,
    "save_places": _save,
    "patch_records": _patch_records,
    "save_sources": _save_sources,
    "retire_types": _retire_types,
    "tombstone_places": _tombstone_all,
    "merge_places": _merge_all,
    "valid_links": _valid,
    "source_gate": _gate,
}

SQL = {
    "candidate_names": """WITH c AS (SELECT DISTINCT c_custkey, unnest([ 's' || (c_custkey % 130), CASE WHEN c_custkey % 3 = 0 THEN 't' || (c_custkey % 7) END, 's' || (c_custkey // 20)]) AS identifies FROM customer),
        v AS (SELECT unnest(['s' || s_suppkey, 't' || (s_suppkey % 11)]) AS identifies, 'name/' || (s_suppkey % 60) AS uri, s_name, s_nationkey, s_suppkey FROM supplier),
        o AS (SELECT c_custkey, uri, arg_max(s_name, s_suppkey) AS text, arg_max(s_nationkey, s_suppkey) AS n FROM c JOIN v USING (identifies) GROUP BY ALL)
        SELECT c_custkey, uri, text, coalesce(n_name, 'n' || n) AS source FROM o LEFT JOIN nation ON n_nationkey = n AND n_nationkey < 20""",
    "names_across_maps": """WITH p AS (SELECT DISTINCT p_brand, p_size % 2 AS m, p_type FROM part WHERE p_size > 20)
        SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_type) FILTER (m = 0) AS on_even, string_agg(p_type, ', ' ORDER BY p_type) FILTER (m = 1) AS on_odd FROM p GROUP BY p_brand""",
    "star_detail": """SELECT c_custkey, c_name, n_name, r_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0)::BIGINT AS n_lines, quantity, last_order
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(coalesce(lines, 0)) AS n_lines, round(coalesce(sum(quantity), 0), 2) AS quantity, max(o_orderdate) AS last_order
                   FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_custkey)
        ON o_custkey = c_custkey""",
    "or_key_lookup": """WITH k AS (SELECT c_custkey, unnest(['id:' || c_custkey, 'name:' || c_name, 'seg:' || c_mktsegment]) AS key FROM customer),
        w AS (SELECT DISTINCT unnest(['id:' || o_custkey, 'seg:BUILDING', 'name:none']) AS key FROM orders)
        SELECT key, min(c_custkey) AS c_custkey FROM w JOIN k USING (key) GROUP BY key""",
    "coalesce_two_keys": """SELECT p_partkey, coalesce(a.s_name, b.found) AS found FROM part
        LEFT JOIN supplier a ON a.s_suppkey % 2 = 0 AND a.s_suppkey = p_partkey % 150
        LEFT JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS found FROM supplier GROUP BY s_nationkey) b ON b.s_nationkey = p_partkey % 40""",
    "ambiguous_match": """WITH k AS (SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
        i AS (SELECT lower(p_name) AS name, min(p_partkey) AS item FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
        SELECT name, item, CASE WHEN n = 1 THEN target END AS match, CASE WHEN n = 1 THEN 'update' WHEN n > 1 THEN 'conflict' ELSE 'insert' END AS outcome FROM i LEFT JOIN k USING (name)""",
    "anti_orgs": "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey",
    "anti_conditional": "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25 AND lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size < 10))",
    "category_left_outer": """SELECT n_name, count(CASE WHEN c_acctbal > 9000 THEN 1 END) AS n, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS n_building
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
    "concept_tree": """WITH RECURSIVE c AS (SELECT 'r' || r_regionkey AS id, NULL AS broader FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
        tree AS (SELECT id, id AS top, 0 AS depth FROM c WHERE broader IS NULL UNION ALL SELECT c.id, t.top, t.depth + 1 FROM c JOIN tree t ON c.broader = t.id) SELECT * FROM tree""",
    "type_lookup_default": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 99 END::INT AS sort FROM customer",
    "facet_and": f"{_TAGS} SELECT custkey FROM t WHERE list_has_all(tags, ['1-URGENT', '5-LOW'])",
    "facet_or": f"{_TAGS} SELECT custkey FROM t WHERE list_has_any(tags, ['1-URGENT', '5-LOW'])",
    "facet_not": f"{_TAGS} SELECT custkey FROM t WHERE NOT list_contains(tags, '2-HIGH')",
    "tombstone_view": """SELECT count(*) FILTER (dep) AS n_deprecated, count(*) FILTER (mer) AS n_merged, count(*) FILTER (NOT dep AND NOT mer) AS n_visible, count(*) FILTER (NOT dep) AS n_with_merged
        FROM (SELECT o_orderstatus = 'P' AS dep, o_orderpriority LIKE '1%' AS mer FROM orders)""",
    "sort_nulls_last_desc": "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey)::INT AS place FROM customer",
    "array_union_distinct": "SELECT o_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderpriority <> '5-LOW'), '') AS tags FROM orders GROUP BY o_custkey",
    "keyed_union": """SELECT p_brand || ' ' || p_name AS p_name, coalesce(min(CASE WHEN p_size <= 25 THEN p_partkey END), min(p_partkey)) AS p_partkey FROM part GROUP BY 1""",
    "name_merge_origin": """SELECT lower(trim(p_brand || ' ' || p_name)) AS key, CASE WHEN min(p_size) <= 3 AND max(p_size) > 3 THEN 'both' WHEN min(p_size) <= 3 THEN 'a' ELSE 'b' END AS origin FROM part GROUP BY 1""",
    "graph_union_counts": """SELECT class, count(*) AS n FROM (SELECT 'E55' AS class FROM region UNION ALL SELECT 'E53' FROM nation UNION ALL SELECT 'E74' FROM customer UNION ALL SELECT 'E25' FROM supplier
        UNION ALL SELECT 'E13' FROM orders UNION ALL SELECT 'E41' FROM part) GROUP BY ROLLUP (class)""",
    "graph_entities": """SELECT 'type/' || r_regionkey AS id, 'E55' AS class, '{"label":"' || r_name || '"}' AS body FROM region
        UNION ALL SELECT 'place/' || n_nationkey, 'E53', '{"label":"' || n_name || '","within":"type/' || n_regionkey || '"}' FROM nation
        UNION ALL SELECT 'org/' || c_custkey, 'E74', '{"label":"' || c_name || '","at":"place/' || c_nationkey || '"}' FROM customer UNION ALL SELECT 'feature/' || s_suppkey, 'E25', '{"label":"' || s_name || '","at":"place/' || s_nationkey || '"}' FROM supplier
        UNION ALL SELECT 'obs/' || o_orderkey, 'E13', '{"about":"org/' || o_custkey || '"}' FROM orders UNION ALL SELECT 'name/' || p_partkey, 'E41', '{"text":"' || p_name || '"}' FROM part""",
    "appellations_by_entity": "SELECT p_brand, count(*) AS n, min(p_name) AS first_name, max(p_name) AS last_name, count(DISTINCT p_name) AS n_names FROM part GROUP BY p_brand",
    "observations_by_org": "SELECT o_custkey AS custkey, count(*) AS n, year(min(o_orderdate))::INT AS first_year, year(max(o_orderdate))::INT AS last_year FROM orders GROUP BY o_custkey",
    "validation_report": """SELECT count(*) AS n, count(*) FILTER (seen) AS with_observation, count(*) FILTER (n_name IS NOT NULL) AS with_place, count(*) FILTER (c_acctbal < 0) AS negative,
        round(count(*) FILTER (seen) / count(*), 6) AS observed_share FROM (SELECT *, c_custkey IN (SELECT o_custkey FROM orders) AS seen FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "column_coverage": """SELECT x.column_name, x.present, total, round(x.present / total, 6) AS share FROM (
        SELECT count(*) AS total, unnest([{'column_name': 'c_custkey', 'present': count(c_custkey)}, {'column_name': 'balance', 'present': count(*) FILTER (c_acctbal > 0)},
               {'column_name': 'segment', 'present': count(*) FILTER (c_mktsegment <> 'BUILDING')}]) AS x FROM customer)""",
    "unlinked_pct": "SELECT round(avg(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 0 ELSE 1 END) * 100, 1) AS unlinked_pct FROM orders",
    "role_unpivot": """SELECT role, value, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM (
        SELECT l_orderkey, 'l_returnflag' AS role, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_linestatus', l_linestatus FROM lineitem) GROUP BY role, value""",
    "provenance_depth": """SELECT dst, depth, count(*) AS n FROM (
        SELECT 'r' || n_regionkey AS dst, 1 AS depth FROM nation UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY dst, depth""",
    "provenance_depth_lines": """SELECT dst, depth, count(*) AS n FROM (
        SELECT 'r' || n_regionkey AS dst, 1 AS depth FROM nation UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY dst, depth""",
    "upsert_places": """SELECT s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, 'new ' || p_name FROM part""",
    "patch_places": f"WITH {_PLACES} SELECT id, CASE WHEN id % 4 = 0 THEN 'patched' WHEN id % 2 = 0 THEN NULL ELSE label END AS label, CASE WHEN id % 2 = 0 THEN size ELSE 0 END AS size FROM places",
    "active_type_guard": """WITH r AS (SELECT type, CASE WHEN type = 'MACHINERY' THEN 'BUILDING' END AS replaced_by FROM (SELECT DISTINCT c_mktsegment AS type FROM customer UNION ALL SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'UNUSED')),
        u AS (SELECT c_mktsegment AS type, count(*) FILTER (c_acctbal >= 0) AS n FROM customer GROUP BY 1)
        SELECT type, coalesce(n, 0) AS n_active, CASE WHEN type LIKE 'Brand%' THEN '404' WHEN coalesce(n, 0) > 0 AND replaced_by IS NULL THEN '409' ELSE '200' END AS status FROM r LEFT JOIN u USING (type)""",
    "dataset_bridge": """SELECT c_nationkey, count(*) AS n_customers, coalesce(max(n), 0) AS n_suppliers FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey GROUP BY c_nationkey""",
    "save_places": """WITH old AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'river' ELSE 'plantation' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || s_suppkey END AS qid FROM supplier),
        r AS (SELECT p_partkey % 1500 AS id, p_name, p_partkey, p_size > 5 AS good, row_number() OVER (PARTITION BY p_partkey % 1500, p_size > 5 ORDER BY p_partkey::VARCHAR) AS nth FROM part),
        one AS (SELECT * FROM r WHERE good AND nth = 1),
        said AS (SELECT r.id, string_agg(CASE WHEN NOT good THEN '400' WHEN nth > 1 THEN '409' WHEN old.id IS NULL THEN '201' ELSE '200' END, ',' ORDER BY CASE WHEN NOT good THEN '400' WHEN nth > 1 THEN '409' WHEN old.id IS NULL THEN '201' ELSE '200' END) AS statuses FROM r LEFT JOIN old USING (id) GROUP BY r.id),
        new AS (SELECT id, name, type, qid, CASE WHEN type = 'river' THEN 'E26_Physical_Feature' ELSE 'E25_Human-Made_Feature' END AS crm_class, NULL AS modified_by, NULL AS modified_at FROM old WHERE id NOT IN (SELECT id FROM one)
                UNION ALL SELECT id, p_name, 'district', 'P' || p_partkey, 'E53_Place', 'editor', p_partkey::VARCHAR FROM one)
        SELECT id, name, type, qid, crm_class, modified_by, modified_at, statuses FROM new FULL JOIN said USING (id)""",
    "patch_records": """WITH old AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'river' ELSE 'plantation' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || s_suppkey END AS qid FROM supplier)
        SELECT coalesce(old.id, c_custkey) AS id, CASE WHEN old.id IS NULL THEN NULL WHEN c_custkey % 2 = 1 THEN 'district' ELSE type END AS type,
          CASE WHEN old.id IS NULL THEN -1 WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN -1 ELSE 1 END AS n_links,
          CASE WHEN old.id IS NULL THEN NULL WHEN c_custkey % 4 = 0 THEN 'Q0' WHEN c_custkey % 2 = 0 THEN NULL ELSE qid END AS qid,
          CASE WHEN old.id IS NULL THEN NULL WHEN c_custkey % 2 = 1 THEN 'E53_Place' WHEN type = 'river' THEN 'E26_Physical_Feature' ELSE 'E25_Human-Made_Feature' END AS crm_class,
          CASE WHEN old.id IS NOT NULL AND c_custkey IS NOT NULL THEN 'editor' END AS modified_by, CASE WHEN c_custkey IS NULL THEN NULL WHEN old.id IS NULL THEN '404' ELSE '200' END AS status
        FROM old FULL JOIN customer ON c_custkey = old.id""",
    "save_sources": """WITH b AS (SELECT p_brand, min(p_partkey) AS k, row_number() OVER (ORDER BY min(p_partkey)) AS nth, count(*) OVER () AS n FROM part GROUP BY p_brand),
        cats AS (SELECT count(*) AS n FROM region), nb AS (SELECT count(DISTINCT p_brand) AS n FROM part),
        old AS (SELECT replace(lower(n_name), '_', '-') AS source_id, n_regionkey::VARCHAR AS category, row_number() OVER (ORDER BY n_nationkey) AS nth,
                CASE WHEN n_nationkey % 5 = 0 THEN '400' WHEN n_nationkey % 2 = 0 THEN '200' ELSE '409' END AS status FROM nation)
        SELECT source_id, cats.n + nb.n + nth - 1 AS pos, CASE WHEN status = '200' THEN 'y' ELSE category END AS category, CASE WHEN status = '200' THEN 'new' ELSE 'old' END AS description, status = '200' AS linked, status FROM old, cats, nb
        UNION ALL SELECT regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), cats.n + b.n - b.nth, 'x', NULL, TRUE, '201' FROM b, cats""",
    "retire_types": """WITH types AS (SELECT DISTINCT c_mktsegment AS type FROM customer UNION SELECT DISTINCT p_brand FROM part), used AS (SELECT DISTINCT c_mktsegment AS type FROM customer WHERE c_acctbal >= 0),
        j AS (SELECT type, type = 'Brand#11' AS gone, CASE WHEN type IN ('BUILDING', 'Brand#12') THEN 'HOUSEHOLD' END AS by_, CASE WHEN type < 'C' THEN 'older' END AS old,
              CASE WHEN type IN (SELECT type FROM used) AND type NOT IN ('BUILDING', 'Brand#12') THEN '409' WHEN type = 'Brand#11' THEN '409' ELSE '200' END AS status FROM types)
        SELECT type, gone OR status = '200' AS deprecated, CASE WHEN status = '200' THEN by_ END AS replaced_by, CASE WHEN status = '200' THEN 'why' END AS deprecation_note,
          CASE WHEN status = '200' THEN concat_ws(' | ', old, 'Deprecated 2024-01-01 by me.' || coalesce(' Replaced by: ' || by_ || '.', '')) ELSE old END AS history_note, status FROM j
        UNION ALL SELECT 'unknown', NULL, NULL, NULL, NULL, '404'""",
    "tombstone_places": f"""WITH {_PLACES}, r AS (SELECT o_custkey AS rid, count(*) AS n, min(o_orderkey) AS t FROM orders GROUP BY o_custkey),
        j AS (SELECT *, CASE WHEN rid IS NULL THEN NULL WHEN id IS NULL THEN '404' WHEN deprecated OR merged_into IS NOT NULL THEN '409' ELSE '200' END AS status FROM places FULL JOIN r ON id = rid)
        SELECT coalesce(id, rid) AS id, CASE WHEN status = '200' THEN TRUE ELSE deprecated END AS deprecated, CASE WHEN status = '200' THEN 'editor' END AS deprecated_by, CASE WHEN status = '200' THEN t END AS deprecated_at,
          CASE WHEN status = '200' THEN left(t::VARCHAR, 3) END AS note, CASE WHEN rid IS NOT NULL THEN (status = '200')::INT END AS n_200, CASE WHEN rid IS NOT NULL THEN (status = '404')::INT END AS n_404,
          CASE WHEN rid IS NOT NULL THEN n - 1 + (status = '409')::INT END AS n_409 FROM j""",
    "merge_places": f"""WITH {_PLACES}, r AS (SELECT p_partkey % 97 + 1 AS keep, p_partkey % 89 + 1 AS retire, p_partkey AS t FROM part),
        one AS (SELECT keep, retire, min(t) AS t, count(*) AS n, bool_and(keep <> retire AND a.id IS NOT NULL AND b.id IS NOT NULL AND a.merged_into IS NULL AND b.merged_into IS NULL) AS fit
                FROM r LEFT JOIN places a ON a.id = keep LEFT JOIN places b ON b.id = retire GROUP BY ALL),
        gone AS (SELECT retire AS id, min(t) AS t FROM one WHERE fit GROUP BY 1), held AS (SELECT keep AS id, min(t) AS t FROM one WHERE fit GROUP BY 1),
        j AS (SELECT o.*, fit AND coalesce(gk.t >= o.t, TRUE) AND coalesce(gr.t >= o.t, TRUE) AND coalesce(hr.t >= o.t, TRUE) AS ok
              FROM one o LEFT JOIN gone gk ON gk.id = keep LEFT JOIN gone gr ON gr.id = retire LEFT JOIN held hr ON hr.id = retire),
        done AS (SELECT retire AS id, sum(CASE WHEN ok THEN keep END)::BIGINT AS into_, sum(n)::BIGINT AS n, count(*) FILTER (ok) AS n_done FROM j GROUP BY 1)
        SELECT coalesce(p.id, d.id) AS id, CASE WHEN p.id IN (SELECT keep FROM j WHERE ok) THEN 'kept ' || label ELSE label END AS label,
          coalesce((SELECT keep FROM j WHERE ok AND retire = p.id), CASE WHEN p.id IN (SELECT keep FROM j WHERE ok) THEN NULL ELSE merged_into END) AS merged_into, into_ AS into, n, n_done
        FROM places p FULL JOIN done d ON d.id = p.id""",
    "valid_links": """WITH e AS (SELECT o_custkey AS src, o_orderdate AS valid_from, min(o_orderpriority) AS dst FROM orders GROUP BY ALL),
        c AS (SELECT * FROM (SELECT *, lag(dst) OVER (PARTITION BY src ORDER BY valid_from) AS before FROM e) WHERE before IS NULL OR before <> dst),
        v AS (SELECT src, dst, valid_from, lead(valid_from) OVER (PARTITION BY src ORDER BY valid_from) AS valid_to FROM c)
        SELECT src, dst, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, valid_from <= TIMESTAMP '2000-01-01' AND coalesce(valid_to > TIMESTAMP '2000-01-01', TRUE) AS held FROM v""",
    "source_gate": "SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
}
