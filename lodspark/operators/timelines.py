"""Who was where, when, and how many were there each year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import shared_path, written

#: A key of more spans than this in the first table has its spans cut into blocks; others are joined by key alone.
DENSE = 512


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str] = ("a_from", "a_until"), b_span: tuple[str, str] = ("b_from", "b_until")) -> DataFrame:
    """Columns of both tables, `from` and `until`, for all pairs with equal keys whose spans have a day in common, each pair once.

    Spans are whole numbers (days, years), `until` no longer counts; a null begin or end is open. Empty
    spans and null keys meet nothing; repeated rows are rows of their own.

    Both tables are written once. A row of `b` meets the spans of its key in `a`, `DENSE` at most. For keys
    that have more of them: two spans overlap if the later one begins within the other. Spans are cut into
    the aligned blocks of 1, 2, 4, ... days that make them up, two of a size at most, and a begin lies in
    one block of each size; so an equi-join by key and block finds each pair at one block, whatever the
    spans' lengths, and such a key is dealt over its blocks.
    """
    folder = shared_path(a.sparkSession, "overlap-spans")
    a, b = written(a, f"{folder}/a"), written(b, f"{folder}/b")
    ends = [x.agg(F.min(s).alias("low"), F.max(s).alias("high"), F.min(u).alias("low2"), F.max(u).alias("high2")) for x, (s, u) in ((a, a_span), (b, b_span))]
    edge = ends[0].unionByName(ends[1]).agg(F.min(F.least("low", "low2")).alias("low"), F.max(F.greatest("high", "high2")).alias("high")).first()
    # An open end is one past all that is named.
    low, high = (edge["low"] or 0) - 1, (edge["high"] or 0) + 1
    levels = max(1, (high - low).bit_length())

    def spans(t: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        begin, end = F.coalesce(F.col(span[0]).cast("long"), F.lit(low)) - low, F.coalesce(F.col(span[1]).cast("long"), F.lit(high)) - low
        t = t.select(*[F.col(c).alias(f"{side}_{n}") for n, c in enumerate(t.columns)], *[F.col(k).alias(f"{side}_key{n}") for n, k in enumerate(keys)], begin.alias(f"{side}_s"), end.alias(f"{side}_u"))
        return t.filter(F.col(f"{side}_s") < F.col(f"{side}_u"))

    def named(met: DataFrame) -> DataFrame:
        both = [F.col(f"a_{n}").alias(c) for n, c in enumerate(a.columns)] + [F.col(f"b_{n}").alias(c) for n, c in enumerate(b.columns) if c not in keys]
        return met.select(*both, (F.greatest("a_s", "b_s") + low).alias("from"), (F.least("a_u", "b_u") + low).alias("until"))

    def blocks(begin: Column, end: Column) -> Column:
        sizes = F.sequence(F.lit(0), F.lit(levels))

        def at(k: Column) -> Column:
            left, right = F.ceil(begin / F.pow(F.lit(2.0), k)).cast("long"), F.floor(end / F.pow(F.lit(2.0), k)).cast("long")
            one = F.when((left < right) & (left % 2 == 1), F.struct(k.alias("size"), left.alias("block")))
            two = F.when((left < right) & (right % 2 == 1), F.struct(k.alias("size"), (right - 1).alias("block")))
            return F.array(one, two)

        return F.array_compact(F.flatten(F.transform(sizes, at)))

    def within(outer: DataFrame, o: str, inner: DataFrame, i: str, later: int) -> DataFrame:
        """Pairs whose inner span begins in the outer one, `later` days after its begin at least."""
        cut = outer.withColumn("x", F.explode(blocks(F.col(f"{o}_s") + later, F.col(f"{o}_u")))).select("*", "x.*").drop("x")
        begins = inner.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.floor(F.col(f"{i}_s") / F.pow(F.lit(2.0), "size")).cast("long"))
        met = cut.alias("o").join(begins.alias("i"), [*same, F.col("o.size") == F.col("i.size"), F.col("o.block") == F.col("i.block")])
        return named(met)

    left, right = spans(a, a_span, "a"), spans(b, b_span, "b")
    same = [F.col(f"a_key{n}") == F.col(f"b_key{n}") for n in range(len(keys))]
    of = [f"a_key{n}" for n in range(len(keys))]
    dense = written(left.groupBy(*of).agg(F.count("a_s").alias("n")).filter(F.col("n") > DENSE).select(*of), f"{folder}/dense")
    some = not dense.isEmpty()
    sparse = left.join(dense, of, "left_anti") if some else left
    met = named(right.join(sparse, [*same, F.col("a_s") < F.col("b_u"), F.col("b_s") < F.col("a_u")]))
    if not some:
        return met
    left = left.join(dense, of, "left_semi")
    right = right.join(dense.select(*[F.col(c).alias(f"b{c[1:]}") for c in of]), [f"b{c[1:]}" for c in of], "left_semi")
    return met.unionByName(within(right, "b", left, "a", 0)).unionByName(within(left, "a", right, "b", 1))


def as_of(rows: DataFrame, key: list[str], year: str, value: str, limit: int, last: int | None = None) -> DataFrame:
    """`rows` with `until`: the last year for which a value stands - the year before the key's next one, `limit` years on at most, and `last` if given.

    Rows without key, year or value say nothing; of several rows of a key and year the largest value stands.
    """
    known = rows.filter(F.col(year).isNotNull() & F.col(value).isNotNull())
    for k in key:
        known = known.filter(F.col(k).isNotNull())
    one = known.groupBy(*key, F.col(year).cast("int").alias(year)).agg(F.max(value).alias(value))
    after = F.lead(year).over(W.partitionBy(*key).orderBy(year)) - 1
    ends = [F.coalesce(after, F.col(year) + limit), F.col(year) + limit, *([F.lit(last)] if last is not None else [])]
    return one.withColumn("until", F.least(*ends).cast("int")).filter(F.col("until") >= F.col(year))


def carried(rows: DataFrame, key: list[str], year: str, value: str, limit: int, last: int | None = None) -> DataFrame:
    """The series of each key, a row for every year for which a value stands: key, year, value, `carried` (not of that year itself)."""
    spans = as_of(rows, key, year, value, limit, last)
    return spans.withColumn("at", F.explode(F.sequence(year, "until"))).select(*key, F.col("at").alias(year), value, (F.col("at") > F.col(year)).alias("carried"))


def by_year(rows: DataFrame, place: str, key: list[str], year: str, value: str, limit: int = 0) -> DataFrame:
    """`place, year, total, n_reported, n_carried, change`: what stands in each place, in every year from the first of all to the last of all.

    Values are carried on `limit` years at most, per place and key. No value is multiplied out over the
    years: each adds at its first year and takes away after its last, tasks add these up by place and
    year, and running sums over the years of a place, which are few, make the series.
    """
    edge = rows.filter(F.col(value).isNotNull()).agg(F.min(F.col(year).cast("int")).alias("low"), F.max(F.col(year).cast("int")).alias("high")).first()
    low, high = edge["low"], edge["high"]
    spans = as_of(rows, [place, *[k for k in key if k != place]], year, value, limit, high)
    plus = F.struct(F.col(year).alias("at"), F.col(value).alias("v"), F.lit(1).alias("standing"), F.lit(1).alias("reported"))
    minus = F.struct((F.col("until") + 1).alias("at"), (-F.col(value)).alias("v"), F.lit(-1).alias("standing"), F.lit(0).alias("reported"))
    steps = spans.select(place, F.explode(F.array(plus, minus)).alias("x")).groupBy(place, F.col("x.at").alias(year)).agg(F.sum("x.v").alias("v"), F.sum("x.standing").alias("standing"), F.sum("x.reported").alias("reported"))
    places = steps.select(place).distinct()
    years = places.withColumn(year, F.explode(F.sequence(F.lit(low), F.lit(high)))) if low is not None else places.withColumn(year, F.lit(None).cast("int"))
    dense = years.join(steps, [place, year], "left")
    own = W.partitionBy(place).orderBy(year)
    total = F.coalesce(F.sum("v").over(own), F.lit(0))
    out = dense.select(place, year, total.alias("total"), F.coalesce("reported", F.lit(0)).alias("n_reported"), (F.coalesce(F.sum("standing").over(own), F.lit(0)) - F.coalesce("reported", F.lit(0))).alias("n_carried"))
    return out.withColumn("change", F.col("total") - F.lag("total").over(own))
