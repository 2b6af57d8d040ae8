"""Mixing sources to target weights, with DataFrame functions only.

Documents get a random key from a hash of their id and text. Keys are dealt to fixed ranges (their leading
hex digits); within a source the ranges follow each other, so the prefix sum of a document is the
sum of the earlier ranges of its source plus a running sum in its own range. No task holds a whole
source, and a source's budget is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, saved, set_aside, workspace

#: Production parameters. Weights repeat over the sources in code-point order, null last.
WEIGHTS, REPEATS, SEED, RANGE_DIGITS = (5, 2, 1), 3, "mix-1", 3
#: Lots that equal rows are dealt to.
LOTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """`source`, `source_size` -> the same with `target`: words that each source gives to the mix.

    All sizes are shared by weight; a target stops at `repeats` times its source's size and the
    excess is shared again by weight. Sources in order of cap per weight are capped while the level
    that remains reaches their cap; the first that is not reached gives the level of all others.
    One row a source: the windows over all rows are one task, meant for up to some millions of sources.
    """
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("w", F.get(pick, F.col("n") % len(weights))).withColumn("cap", F.col("source_size") * repeats)
    by_level = W.orderBy(F.col("cap") / F.col("w"), "n")
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    free = F.col("level") < F.col("cap") / F.col("w")
    level = F.max(F.when(free, F.col("level"))).over(W.partitionBy())
    return ranked.select("source", "source_size", F.when(free, level * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def _key(seed: str = SEED) -> Column:
    """A document's place in its source: random, but the same on each run. Texts under one id, or without one, have places of their own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def _words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_SPACE)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken` for every row of `docs` (doc_id, text, source).

    `taken` is the whole epochs of the document plus what the last, partial epoch takes of it in
    hash-random order; the document at the cut gives only the words that are left of the budget.
    Null or empty text has size 0 and is taken 0 words; a null source is a source of its own, sorted
    last; null ids are told apart by their texts; rows with equal id and text follow each other and are
    counted each; an empty table gives no rows. The result reads the sizes from a scratch table.
    """
    return _plan(docs, weights, repeats, seed, range_digits).drop("key")


def _plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, range_digits: int = RANGE_DIGITS, folder: str | None = None) -> DataFrame:
    """The rows of `mix` with their `key`; sizes lie in `folder`, or else in a scratch table."""
    # Key and word count are the costly expressions: they are computed once and written. Equal rows can
    # take each other's place, so which of them carries which lot makes no difference to the result.
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(LOTS))
    sized = saved(docs.select("doc_id", "source", _words().alias("size"), _key(seed).alias("key"), lot.alias("lot")), "mix-sizes", folder and f"{folder}/sizes")
    sized = sized.withColumn("part", F.substring("key", 1, range_digits))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, repeats)
    goal = goal.withColumn("budget", F.round("target").cast("long")).withColumnRenamed("source", "goal_source")
    earlier = F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = parts.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    offsets = offsets.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("part_source"), F.col("part").alias("of_part"), "earlier", "source_size", "target", "budget")
    # Equal rows are one group a lot until their range is summed up: a range's task has LOTS rows of them at most.
    groups = sized.groupBy("source", "part", "key", "doc_id", "size", "lot").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source", "part").orderBy("key", "doc_id", "size", "lot").rowsBetween(W.unboundedPreceding, 0)
    many = F.col("n") * F.col("size")
    groups = groups.withColumn("first", F.sum(many).over(order) - many).repartition("key", "doc_id", "lot")
    placed = groups.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("within", F.col("first") + F.col("copy") * F.col("size"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("of_part")))
    size, whole = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    rest = F.col("budget") % whole - F.col("earlier") - F.col("within")
    epochs = F.floor(F.col("budget") / whole).cast("long")
    taken = epochs * size + F.least(size, F.greatest(rest, F.lit(0)))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


def mixed(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents of the mix, in the columns of `docs`, each as often as it is taken.

    A document at a source's cut is kept whole, so a source may exceed its budget by less than one
    document; rows with equal id and text stand at one place of the order and go together.
    Documents that give no words are left out. Each source's cut is one row, which every document is
    compared to: no text is shuffled.
    """
    spark = docs.sparkSession
    docs, back = set_aside(docs, ("mix_cut", "mix_time"))
    with workspace(spark, "mix") as folder:
        plan = _plan(docs, folder=folder)
        budget, whole = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
        plan = plan.withColumn("epochs", F.floor(budget / whole).cast("int"))
        partly = F.col("taken") > F.col("epochs") * F.col("size")
        cuts = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(partly, F.col("key"))).alias("cut"))
        # Written, so that its size is known when the join is planned: broadcast if small, else shuffled.
        cuts = saved(cuts.select(F.struct("source", "epochs", "cut").alias("mix_cut")), "mix-cuts")
    met = docs.join(cuts, F.col("source").eqNullSafe(F.col("mix_cut.source")))
    times = F.col("mix_cut.epochs") + F.coalesce((_key() <= F.col("mix_cut.cut")).cast("int"), F.lit(0))
    met = met.filter(F.col("text").rlike(NOT_SPACE) & (times > 0))
    return met.withColumn("mix_time", F.explode(F.sequence(F.lit(1), times))).select(docs.columns).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n,
         list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT) AS w
  FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goals AS (
  SELECT source, source_size,
         CASE WHEN level < cap / w THEN max(CASE WHEN level < cap / w THEN level END) OVER () * w ELSE cap::DOUBLE END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS budget, greatest(g.source_size, 1) AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS earlier
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (budget // whole * size + least(size, greatest(budget % whole - earlier, 0)))::BIGINT AS taken
FROM placed
"""
