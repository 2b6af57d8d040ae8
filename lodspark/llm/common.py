"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Buffers of batches go back to the system when they are freed: several Python workers share an executor's memory.
pa.set_memory_pool(pa.system_memory_pool())

#: ASCII white space separates words in every contract of this package.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none.

    On a cluster a folder of the driver's own would lose rows, so there it has to be configured.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lodspark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Scratch paths by open `swept` block.
_made: list[list[tuple[str, str]]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append((name, path))
    return path


@contextmanager
def swept(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Scratch tables made in the block go at its end, also after an error, but those of the names in `kept`: what reads them lazily has to be written in the block."""
    _made.append([])
    try:
        yield
    finally:
        for name, path in _made.pop():
            if name not in kept:
                discard(spark, path)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared folder for tables that nothing needs after the block: it is removed then, also after an error."""
    path = scratch(spark, name)
    try:
        yield path
    finally:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns of these names (in any case) renamed, and the renaming that gives the names back.

    A stage that needs columns of its own beside all those of its documents loses none of them this way.
    """
    taken, back = {c.lower() for c in docs.columns} | {n.lower() for n in names}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            other = f"{c}_"
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            back[other] = c
    return docs.withColumnsRenamed({c: other for other, c in back.items()}), back


def fold_of(n: int) -> Column:
    """crc32 of the id's decimal text modulo n: the fixed folds of the contracts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(n)


def held_out(n: int, fold: int) -> Column:
    """Whether a document is in a fold; false for a null id, whose row is in none (nor learnt from)."""
    return F.coalesce(fold_of(n) == fold, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column without copying each value; null counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, one row at least: bounds the memory of vectorised work."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def sample_ids(rows: DataFrame, label: str, limit: int, seed: int) -> DataFrame:
    """A bounded sample of labelled ids, the same on each run: the `limit` lowest hashes of their ids.

    An id and its label is one candidate however many rows repeat it, so repeats neither crowd out
    other ids nor outgrow `limit`, which bounds what is later broadcast; an id with both labels is two.
    Rows without id or label are left out.
    """
    rows = rows.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id", "label").limit(limit).drop("h")
