"""Search without a scan: an inverted index of trigrams over the text fields of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedupe import in_sequence
from .scratch import workspace

#: Folders that grams are dealt to, records of a block (a posting list has no more in one row), grams of a query that are intersected.
BUCKETS, BLOCK_BITS, PICKED = 64, 14, 3


_POSTINGS = "gram string, block int, many int, within array<short>, bucket int"
#: What stands behind a text, so that a gram begins at each of its letters.
_END = "\0\0"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; overlapping ones come from a look-ahead, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class TrigramIndex:
    """Segments of records beside their postings; appending writes a segment of its own.

    A segment numbers its records. `records` lie in folders by block of numbers, `postings` in folders by
    bucket of grams: a row has a gram, a block, how many records of it have the gram, and their numbers
    within the block. So a query reads the buckets of its rarest grams and the
    blocks of what these have in common, and looks for its text in those records only.

    Fields: text columns, or lists of texts. A text is looked for in any case, within one field or one
    element of a list; nulls hold nothing.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], key: str = "id"):
        self.spark, self.path, self.fields, self.key = spark, path.rstrip("/"), fields, key

    def _segments(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = [p.getPath() for p in fs.listStatus(where) if p.getPath().getName().startswith("segment-")]
        return sorted(p.getName() for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "counts/_SUCCESS")))

    def append(self, rows: DataFrame, pos: str | None = None) -> str | None:
        """Add records (key and fields; other columns stay out) as a segment; the last table to be written makes it visible. Without `pos` records are numbered by a hash; no records, no segment."""
        name = f"segment-{len(self._segments()):05d}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        path = f"{self.path}/{name}"
        kind = dict(rows.dtypes)
        texts = [F.coalesce(F.col(f), F.array()) if kind[f].startswith("array") else F.array(F.col(f).cast("string")) for f in self.fields]
        own = rows.select(F.struct(F.col(self.key), *self.fields).alias("record"), F.filter(F.concat(*texts), lambda t: t.isNotNull()).alias("texts"), (F.col(pos) if pos else F.lit(None).cast("long")).alias("at"))
        with workspace(self.spark, "index-rows") as folder:
            numbered = in_sequence([own], "at", path=f"{folder}/rows").select("record", "texts", (F.col("seq") - 1).alias("n"))
            if numbered.isEmpty():
                return None
            block = F.shiftright("n", BLOCK_BITS).cast("int").alias("block")
            numbered.select("n", block, "texts", "record").write.partitionBy("block").parquet(f"{path}/records")
            said = self.spark.read.parquet(f"{path}/records").select("n", "block", F.explode(F.array_distinct(F.flatten(F.transform("texts", lambda t: grams(F.concat(t, F.lit(_END))))))).alias("gram"))
            lists = said.groupBy("gram", "block").agg(F.sort_array(F.collect_list("n")).alias("ns"))
            within = F.transform("ns", lambda x: F.pmod(x, F.lit(1 << BLOCK_BITS)).cast("short"))
            lists = lists.select(_bucket(F.col("gram")).alias("bucket"), "gram", "block", F.size("ns").alias("many"), within.alias("within"))
            lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
            made = self.spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
            made.groupBy("gram").agg(F.sum("many").alias("many")).write.parquet(f"{path}/counts")
        return name

    def search(self, queries: DataFrame) -> DataFrame:
        """`query` and the key of every record that holds it, for all of a table of queries (column `query`) at once.

        Queries are trimmed; those of one or two letters take the postings of all grams that begin with
        them; blank ones meet nothing, repeated ones count once.
        """
        wanted = queries.select(F.trim("query").alias("query")).filter("query <> ''").distinct()
        parts = [self._in(s, wanted) for s in self._segments()]
        return reduce(DataFrame.unionByName, parts) if parts else wanted.select("query", F.lit(None).cast("string").alias(self.key)).limit(0)

    def _in(self, segment: str, wanted: DataFrame) -> DataFrame:
        read = lambda name: self.spark.read.parquet(f"{self.path}/{segment}/{name}")
        asked = wanted.withColumn("low", F.lower("query"))
        short = asked.filter(F.length("low") < 3)
        said = asked.filter(F.length("low") >= 3).select("query", F.explode(grams(F.col("low"))).alias("gram"))
        # The rarest grams of each query; one that the segment has not at all leaves it without a record.
        known = said.join(read("counts"), "gram", "left")
        best = known.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram"))), 1, PICKED).alias("best"))
        best = best.filter(F.col("best")[0]["many"] > 0).select("query", F.posexplode("best").alias("rank", "b")).select("query", "rank", F.col("b.gram").alias("gram"), _bucket(F.col("b.gram")).alias("bucket"))
        begins = read("counts").select("gram", F.explode(F.array_distinct(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2)))).alias("low"))
        any_of = short.join(begins, "low").select("query", F.lit(0).alias("rank"), "gram", _bucket(F.col("gram")).alias("bucket"))
        lists = best.unionByName(any_of).join(self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/{segment}/postings"), ["bucket", "gram"])
        each = lists.select("query", "rank", "block", F.explode("within").alias("w")).select("query", "rank", "block", (F.shiftleft(F.col("block").cast("long"), BLOCK_BITS) + F.col("w")).alias("n"))
        met = each.filter("rank = 0").drop("rank").distinct()
        for k in range(1, PICKED):
            # Queries with fewer grams than that lose nothing.
            has = best.filter(F.col("rank") == k).select("query").withColumn("has", F.lit(True))
            other = each.filter(F.col("rank") == k).select("query", "block", "n").withColumn("there", F.lit(True))
            met = met.join(has, "query", "left").join(other, ["query", "block", "n"], "left").filter("has is null or there").drop("has", "there")
        records = read("records")
        found = records.join(met.withColumn("low", F.lower("query")), ["block", "n"])
        return found.filter(F.exists("texts", lambda t: F.lower(t).contains(F.col("low")))).select("query", F.col(f"record.{self.key}").alias(self.key))
