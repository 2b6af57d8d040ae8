"""Writers: tables are the truth; documents are exported from them, and stores keep numbered snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.functions.uri import BASE, ONTOLOGY
from lodspark.operators.dedupe import in_sequence

#: Namespaces and members of documents, public fixed values.
CONTEXT = {"@version": 1.1, "id": BASE, "onto": ONTOLOGY, "crm": "http://www.cidoc-crm.org/cidoc-crm/", "skos": "http://www.w3.org/2004/02/skos/core#", "wd": "http://www.wikidata.org/entity/"}


def lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out: the export for large graphs."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def document(rows: DataFrame, path: str, member: str, head: dict) -> int:
    """One JSON document as text parts in the folder `path`: `head`, then the rows' JSON (column `body`) as a list named `member`, in `pos` order. Returns the number of rows.

    Executors write the parts; read one after the other, in the order of their names, they are the
    document. `joined` makes one file of them.
    """
    body = in_sequence([rows.select("pos", "body")]).select(F.lit(1).alias("section"), "seq", F.concat(F.when(F.col("seq") > 1, F.lit(",")).otherwise(F.lit("")), "body").alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, 0, json.dumps(head, ensure_ascii=False)[:-1] + f', "{member}": ['), (2, 0, "]}")], "section int, seq long, value string")
    body.unionByName(ends).orderBy("section", "seq").select("value").write.text(path)
    return rows.count()


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of a folder as one file: bytes pass through, nothing is parsed or held."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    names = sorted(p.getPath().getName() for p in fs.listStatus(source) if p.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()


def jsonld(rows: DataFrame, path: str, modified: str, uri: str = BASE + "graph") -> int:
    """A JSON-LD document of entity rows (`pos, body`)."""
    return document(rows, path, "@graph", {"@context": CONTEXT, "@id": uri, "@type": "crm:E73_Information_Object", "modified": modified})


def geojson(rows: DataFrame, path: str) -> int:
    """A feature collection of feature rows (`pos, body`)."""
    return document(rows, path, "features", {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}})


def feature(geometry_type: Column, coordinates: Column, **properties: Column) -> Column:
    """A feature's JSON; properties keep their nulls out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(geometry_type.alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


#: The keyed tables of an index set: name, class of its entities (null: what `provenance` gives), key in the body. Fixed values.
INDEXES = [
    ("plantations", "E25", None), ("physical_features", "E26", None), ("organizations", "E74", None), ("places", "E53", None),
    ("sources", "E22", None), ("appellations_by_entity", "E41", "identifies"), ("observations_by_org", "E13", "about"),
]


def index_set(graph: DataFrame, provenance: DataFrame) -> dict[str, DataFrame]:
    """The eight keyed tables of a graph (id, class, body, pos): `key, id, body`, by id (the last entity of an id by `pos` wins, without one the greatest text), names by what they name and observations by organization.

    Names and observations without such a key are left out, as are entities of other classes.
    Grouped entries stay rows, so no list of a key has to fit in one.
    """
    out = {}
    for name, code, key in INDEXES:
        rows = graph.filter(F.col("class") == code)
        if key:
            keyed = rows.withColumn("key", F.get_json_object("body", f"$.{key}"))
            out[name] = keyed.filter(F.coalesce("key", F.lit("")) != "").select("key", "id", "body")
        else:
            out[name] = _by_id(rows)
    return out | {"provenance": _by_id(provenance)}


def _by_id(rows: DataFrame) -> DataFrame:
    last = F.max_by("body", F.struct("pos", "body")) if "pos" in rows.columns else F.max("body")
    return rows.groupBy("id").agg(last.alias("body")).select(F.col("id").alias("key"), "id", "body")


def indexes(tables: dict[str, DataFrame], path: str) -> None:
    """Keyed tables side by side, each as Parquet."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


class Conflict(RuntimeError):
    """Another writer has made the snapshot that this one was to become."""


#: Age at which a claim to a version is taken for that of a writer that is gone.
CLAIM_SECONDS = 3600


class SnapshotStore:
    """Numbered snapshots of one table. A write names the version it has read; of two such writers one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest complete snapshot, 0 before the first."""
        where, fs = self._files()
        if not fs.exists(where):
            return 0
        found = [p.getPath() for p in fs.listStatus(where)]
        done = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max([int(n[2:]) for n in done if n.startswith("v=")], default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.version()}")

    def write(self, table: DataFrame, read_version: int) -> int:
        """Write what became of snapshot `read_version`; fails if that is no longer the latest. A write that fails leaves nothing behind."""
        return self._publish(self._staged(table), read_version)

    def _staged(self, table: DataFrame) -> str:
        path = f"{self.path}/_new-{uuid.uuid4().hex}"
        try:
            table.write.parquet(path)
        except BaseException:
            self._remove(path)
            raise
        return path

    def _remove(self, path: str) -> None:
        where, fs = self._files()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _publish(self, staged: str, read_version: int) -> int:
        """Give a written table its number; the claim is made first and goes again, whatever happens."""
        where, fs = self._files()
        of = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(where, name)
        version = read_version + 1
        try:
            claim = of(f"_claim-{version}")
            if fs.exists(claim) and time.time() * 1000 - fs.getFileStatus(claim).getModificationTime() > CLAIM_SECONDS * 1000:
                fs.delete(claim, False)  # its writer was killed: a rename takes no such time
            if not fs.createNewFile(claim):
                raise Conflict(f"{version} is being written")
            try:
                if self.version() != read_version:
                    raise Conflict(f"read {read_version}, now {self.version()}")
                if not fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(staged), of(f"v={version}")):
                    raise Conflict(f"{version} could not be made")
            finally:
                fs.delete(of(f"_claim-{version}"), False)
        finally:
            self._remove(staged)
        return version

    def change(self, make: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> DataFrame:
        """Apply a change to the latest snapshot; a dry run, or a change of nothing, writes no version.

        The change is computed once, into a table beside the snapshots; whether it changed anything is
        told by row counts and sums of two hashes, without a shuffle.
        """
        at = self.version()
        before = self.read(at)
        after = make(before)
        if dry_run:
            return after
        staged = self._staged(after)
        written = self.spark.read.schema(after.schema).parquet(staged)
        if before.columns == after.columns and _digest(before) == _digest(written):
            self._remove(staged)
            return before
        return self.read(self._publish(staged, at))


def _digest(rows: DataFrame) -> tuple:
    """Count and hash sums of a table's rows: equal for equal rows in any order."""
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    return tuple(rows.agg(F.count(F.lit(1)).alias("n"), *sums).first())
