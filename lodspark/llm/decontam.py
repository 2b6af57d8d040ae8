"""Benchmark decontamination: a broadcast hash set of normalised test windows meets every training window.

Benchmark items are few but not bounded by contract, so they are broadcast in blocks of bounded
size; each block is one more pass over the documents. Hash hits are verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, saved, scratch, set_aside, spans_of, utf8
from .words import FOLD_BYTES, split_words, window_hashes, word_hashes

#: Words in a window; bytes of benchmark text that one broadcast may hold.
WINDOW, BLOCK_BYTES = 10, 16 << 20
_BITS = 22

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class WindowSet:
    """The windows of some benchmark items, by length: sorted hashes with their places, a bitmap before them, and the words to verify.

    Each window takes 16 bytes (hash and place) beside its item's normalised text, which is held once.
    """

    def __init__(self, items: list[tuple[str, str]], size: int):
        split = [(name, w) for name, text in items if (w := split_words((text or "").encode()))]
        self.names = [name for name, _ in split]
        self.text = b" ".join(b" ".join(w) for _, w in split)
        many = np.array([len(w) for _, w in split], np.int64)
        long = np.fromiter((len(x) for _, w in split for x in w), np.int64)
        self.stop = np.cumsum(long + 1) - 1
        self.start = self.stop - long
        #: First word of each item.
        self.first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        words, _ = word_hashes(np.frombuffer(self.text, np.uint8), np.array([0, len(self.text)], np.int64))
        length = np.minimum(many, size)
        last = np.repeat(self.first[1:] - length, many)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            place = np.flatnonzero((np.repeat(length, many) == n) & (np.arange(len(words)) <= last))
            hashes = window_hashes(words, n)[place]
            by = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes >> np.uint64(64 - _BITS)] = True
            self.by_length.append((n, hashes[by], place[by], bitmap))

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the window length and start positions whose hash is in the set."""
        for k, (n, hashes, _, bitmap) in enumerate(self.by_length):
            h = window_hashes(words, n)
            maybe = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            if len(maybe):
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                yield k, maybe[hashes[at] == h[maybe]]

    def owners(self, k: int, key: bytes, h: np.uint64) -> set[str]:
        """Names of the items that have this very window."""
        _, hashes, place, _ = self.by_length[k]
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        n = self.by_length[k][0]
        same = [w for w in place[low:high].tolist() if self.text[self.start[w] : self.stop[w + n - 1]] == key]
        return {self.names[i] for i in np.searchsorted(self.first, same, "right") - 1} if same else set()


def _scan(found: WindowSet, text: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words, hit spans and hit items of each text."""
    data, offsets = utf8(text)
    counts, spans, items = [], [[] for _ in range(len(text))], [[] for _ in range(len(text))]
    for low, high in spans_of(offsets, 1 << 20):
        words, first = word_hashes(data, offsets[low : high + 1])
        counts.append(np.diff(first))
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, starts in found.candidates(words):
            n = found.by_length[k][0]
            of = np.searchsorted(first, starts, "right") - 1
            inside = starts + n <= first[of + 1]
            for d, i in zip(of[inside].tolist(), (starts - first[of])[inside].tolist(), strict=True):
                hits[d].append((i, n, k))
        for d, places in hits.items():
            own = split_words(data[offsets[low + d] : offsets[low + d + 1]].tobytes())
            names: set[str] = set()
            real = []
            for i, n, k in sorted(places):
                h = window_hashes(words[first[d] + i : first[d] + i + n], n)[0]
                owners = found.owners(k, b" ".join(own[i : i + n]), h)
                if owners:
                    names |= owners
                    if real and i <= real[-1][1]:
                        real[-1] = (real[-1][0], max(real[-1][1], i + n))
                    else:
                        real.append((i, i + n))
            spans[low + d], items[low + d] = real, sorted(names)
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), spans, items


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of `block_bytes` and one more item at most, brought to the driver one partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += len(row.t.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """`docs` with `n_words`, `spans` (word ranges covered by benchmark windows, merged) and `items` (their ids, sorted).

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words; items without words never hit; null item ids count
    as ''. All columns of `docs` pass through (`keep_text=False` leaves out `text`); names that clash
    with the new ones are replaced. An empty benchmark or table gives no hits.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark, whole, found, held = docs.sparkSession, docs.columns, None, []
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        if k:  # a table between two passes: no task holds two blocks
            held.append(scratch(spark, "decontam-hits"))
            found = saved(found, "decontam-hits", held[-1])
            if len(held) > 1:
                discard(spark, held.pop(0))
        found = _pass(docs if found is None else found, WindowSet(block, size))
    found = _pass(docs, WindowSet([], size)) if found is None else found
    return found if keep_text else found.select(*[c for c in whole if c != "text"], *HITS.names)


def _pass(docs: DataFrame, block: WindowSet) -> DataFrame:
    """`docs` with the hits of one block, added to those it has already."""
    held = [f for f in docs.schema.fields if f.name not in HITS.names]
    again = len(held) < len(docs.schema.fields)
    out = T.StructType(held + HITS.fields)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            counts, spans, items = _scan(shared.value, column("text"))
            if again:
                before = [[(x["start"], x["stop"]) for x in row] for row in column("spans").to_pylist()]
                spans = [_union(a, b) for a, b in zip(before, spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(column("items").to_pylist(), items, strict=True)]
            kinds = [pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]
            arrays = [column(f.name) for f in held]
            arrays += [pa.array(counts, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], kinds[0]), pa.array(items, kinds[1])]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return docs.mapInArrow(run, out)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged ranges of both lists."""
    out: list[tuple[int, int]] = []
    for low, high in sorted([*a, *b]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW) -> DataFrame:
    """`docs` without contamination, in its own columns.

    `mode="documents"` removes each document with a hit; `mode="spans"` keeps every document and cuts
    the words of hit spans, with what separates them, out of its text (`n_chars` follows where present).
    All other columns keep their values, those named like the columns of `find` too.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    docs, back = set_aside(docs, tuple(HITS.names))
    found = find(docs, benchmark, size)
    if mode == "documents":
        return found.filter(F.size("spans") == 0).select(docs.columns).withColumnsRenamed(back)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            texts = [t if not s else _without(t, s) for t, s in zip(texts, spans, strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in schema.names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in schema.names], schema.names)

    return found.mapInArrow(cut, schema).withColumnsRenamed(back)


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], folded.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : starts[s["start"]]])
        at = starts[s["stop"]] if s["stop"] < len(starts) else ends[s["stop"] - 1]
    return b"".join([*kept, raw[at:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: hits of every document against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.key = x.key),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id
"""
