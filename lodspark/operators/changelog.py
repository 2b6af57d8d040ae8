"""Histories of records: a log of changes beside a base, read as of any version, and written back into a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.sources.sinks import Conflict

from .scratch import remove


class ChangeLog:
    """A table of records, kept as a base and the changes since: a change costs its own rows, not the table's.

    Records: a string or number `key`, once each, and the fields of `schema` (DDL, key included). A version is a folder
    `change-N` with rows `key, fields, record`: the fields that the change sets (null: the record is
    removed) and their values. `read` merges on the fly; `compact` writes a new base. A folder is
    published by a rename, and of two writers of a version one gets a `Conflict`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.key, self.ddl = spark, path.rstrip("/"), key, schema
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        where, fs = self._fs()
        if not fs.exists(where):
            return []
        return sorted(int(n.removeprefix(f"{kind}-")) for n in (p.getPath().getName() for p in fs.listStatus(where)) if n.startswith(f"{kind}-"))

    def version(self) -> int:
        """The latest version, 0 before the first."""
        return max([*self._numbers("change"), *self._numbers("base")], default=0)

    def _publish(self, rows: DataFrame, name: str) -> None:
        where, fs = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        staged = f"{self.path}/_new-{name}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        try:
            rows.write.parquet(staged)
            if fs.exists(path(where, name)) or not fs.createNewFile(path(where, f"_claim-{name}")):
                raise Conflict(name)
            try:
                if fs.exists(path(where, name)) or not fs.rename(path(staged), path(where, name)):
                    raise Conflict(name)
            finally:
                fs.delete(path(where, f"_claim-{name}"), False)
        finally:
            remove(self.spark, staged)

    def changes(self, after: int, until: int) -> DataFrame:
        """`version, key, fields, record` of the changes after one version, up to another."""
        numbers = [n for n in self._numbers("change") if after < n <= until]
        kind = f"{self.key} {self.schema[self.key].dataType.simpleString()}, fields array<string>, record struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in self.schema)}>"
        if not numbers:
            return self.spark.createDataFrame([], f"version int, {kind}")
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/change-{n}" for n in numbers])
        return rows.select(F.regexp_extract(F.input_file_name(), r"/change-(\d+)/", 1).cast("int").alias("version"), self.key, "fields", "record")

    def read(self, version: int | None = None) -> DataFrame:
        """The records as of a version: the base before it, and of each field the last value that a change set; a removed record is there again if a later change names it, with what that change sets."""
        version = self.version() if version is None else version
        base = max((n for n in self._numbers("base") if n <= version), default=0)
        log = self.changes(base, version)
        gone = F.max(F.when(F.col("fields").isNull(), F.col("version"))).alias("gone")
        ends = log.groupBy(self.key).agg(gone, F.max("version").alias("last"))
        set_ = log.join(ends, self.key).filter("fields is not null and (gone is null or version > gone)")
        named = lambda f: F.when(F.array_contains("fields", f), F.col("version"))
        values = [F.max_by(F.struct(F.col(f"record.{f}").alias("v")), named(f)).alias(f"_{n}") for n, f in enumerate(self.columns) if f != self.key]
        now = ends.join(set_.groupBy(self.key).agg(*values), self.key, "left") if values else ends
        old = self.spark.read.schema(self.schema).parquet(f"{self.path}/base-{base}") if base else self.spark.createDataFrame([], self.schema)
        old = old.withColumn("_there", F.lit(True))
        met = old.join(now, self.key, "full")
        removed = F.col("gone").isNotNull() & (F.col("gone") == F.col("last"))
        kept = F.coalesce("_there", F.lit(False)) & F.col("gone").isNull()
        out = [F.col(self.key) if f == self.key else F.when(F.col(f"_{n}").isNotNull(), F.col(f"_{n}.v")).otherwise(F.when(kept, F.col(f))).alias(f) for n, f in enumerate(self.columns)]
        return met.filter(~F.coalesce(removed, F.lit(False))).select(*out)

    def write(self, changes: DataFrame, read_version: int) -> tuple[int, DataFrame]:
        """Write changes (`key, fields`, and columns for the values) made on what was read at a version: the version they became, and `key, status`.

        400 without key, and for all but the first of a key (by its values); 404 a removal of what is not
        there; 409 if another has since removed the record, or set a field that the change sets: the
        others are written, field by field, however far the log has gone on. 200 done, 201 added.
        """
        now = self.version()
        fields = [f for f in self.columns if f in changes.columns or f == self.key]
        record = F.struct(*[(F.col(f) if f in fields else F.lit(None).cast(self.schema[f].dataType)).alias(f) for f in self.columns])
        rows = changes.select(self.key, F.array_sort("fields").alias("fields"), record.alias("record"))
        packed = F.struct("fields", "record")
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(packed, F.xxhash64(F.to_json(packed))).alias("c"), F.count(F.lit(1)).alias("n"))
        since = self.changes(read_version, now).groupBy(self.key).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("fields", F.array(F.lit("*")))))).alias("since"))
        there = self.read(now).select(self.key).withColumn("there", F.lit(True))
        met = one.join(since, self.key, "left").join(there, self.key, "left").withColumn("there", F.coalesce("there", F.lit(False)))
        clash = F.coalesce(F.array_contains("since", "*") | F.when(F.col("c.fields").isNull(), F.size("since") > 0).otherwise(F.arrays_overlap("since", "c.fields")), F.lit(False))
        status = F.when(F.col("c.fields").isNull() & ~F.col("there") & ~clash, "404").when(clash, "409").otherwise(F.when(F.col("there"), "200").otherwise("201"))
        judged = met.withColumn("status", status)
        done = judged.filter("status in ('200', '201')").select(self.key, "c.fields", "c.record")
        self._publish(done, f"change-{now + 1}")
        others = judged.filter("n > 1").select(self.key, F.explode(F.array_repeat(F.lit("400"), (F.col("n") - 1).cast("int"))).alias("status"))
        refused = rows.filter(F.col(self.key).isNull()).select(self.key, F.lit("400").alias("status"))
        return now + 1, judged.select(self.key, "status").unionByName(others).unionByName(refused)

    def compact(self) -> int:
        """Write the latest version as a base; changes stay, for versions before it."""
        now = self.version()
        if now not in self._numbers("base") and now:
            self._publish(self.read(now), f"base-{now}")
        return now

    def difference(self, before: int, after: int) -> DataFrame:
        """`key, field, old, new` (as text) of all fields that differ between two versions; only records that the log names in between are looked at."""
        named = self.changes(min(before, after), max(before, after)).select(self.key).distinct()

        def long(version: int, name: str) -> DataFrame:
            t = self.read(version).join(named, self.key, "left_semi")
            text = lambda f: F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"})
            pairs = [F.struct(F.lit(f).alias("field"), text(f).alias(name)) for f in self.columns if f != self.key]
            return t.select(self.key, F.explode(F.array(*pairs)).alias("x")).select(self.key, "x.*")

        met = long(before, "old").join(long(after, "new"), [self.key, "field"], "full")
        value = lambda c: F.get_json_object(c, "$.v").alias(c)
        return met.filter(~F.col("old").eqNullSafe(F.col("new"))).select(self.key, "field", value("old"), value("new"))
