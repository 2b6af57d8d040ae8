"""Fill-in-the-middle rearrangement by a parallel automaton scan.

A text's units are runs of ASCII letters and single other code points. An automaton of four states
reads UTF-8 bytes and says where a unit begins and where a control string (`<P>`, `<S>`, `<M>`) ends.
It is compiled to its transition functions: a block of bytes that starts in an unknown state maps each
possible state to the state it ends in, to the number of units that began, and to whether a control
string ended. Such maps compose associatively, so all blocks are read at once, a column of bytes at a
time, and composition then tells the state in which each block really starts.

The same maps carry giant documents over tasks: texts above CHUNK bytes are dealt in chunks, every
chunk emits its map, the maps of a text are composed, and a cut is looked for in the one chunk where
the numbers of units say it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, spans_of, utf8

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts stay plain from this remainder of 100 on; of the others, suffix goes first below that one.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Bytes of a chunk: longer texts are dealt over tasks. Bytes of short texts that are read together.
CHUNK, SLICE = 1 << 16, 1 << 20
#: Bytes of a block, whose units are counted in eight bits.
_WIDTH = 128

#: Classes of bytes: letters, the letters of the marks, `<`, `>`, other beginnings of code points, continuations.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 0
_CLASS[list(b"PSM")] = 1
_CLASS[ord("<")], _CLASS[ord(">")] = 2, 3
_CLASS[128:192] = 5
_KINDS = 6

#: States: after no letter, after a letter, after `<`, after `<` and a mark's letter. Next state by class.
_NEXT = [[1, 1, 2, 0, 0, 0], [1, 1, 2, 0, 0, 1], [1, 3, 2, 0, 0, 2], [1, 1, 2, 0, 0, 3]]
_STATES = len(_NEXT)
#: Whether a unit begins, and whether a control string ends.
_BEGINS = [[s not in (1, 3)] * 2 + [True] * 3 + [False] for s in range(_STATES)]
_ENDS = [[s == 3 and c == 3 for c in range(_KINDS)] for s in range(_STATES)]

OUT = T.StructType([
    T.StructField("n_units", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


class Map(NamedTuple):
    """What a stretch of bytes does, by the state it starts in (last axis): state it ends in, units begun, whether a control string ended."""

    ends: np.ndarray
    units: np.ndarray
    marked: np.ndarray

    def then(self, other: Map) -> Map:
        """This stretch followed by another; works on rows of stretches at once. Associative."""
        at = self.ends.astype(np.intp)
        take = lambda x: np.take_along_axis(x, at, -1)
        return Map(take(other.ends), self.units + take(other.units), self.marked | take(other.marked))

    def whole(self) -> Map:
        """All rows, one after another, as one stretch: neighbours are composed until one is left."""
        left = self
        while len(left.ends) > 1:
            even = len(left.ends) & ~1
            pairs = Map(*(x[:even:2] for x in left)).then(Map(*(x[1:even:2] for x in left)))
            left = Map(*(np.concatenate([p, x[even:]]) for p, x in zip(pairs, left, strict=True)))
        return Map(*(x[0] for x in left))


def _compiled() -> tuple[np.ndarray, ...]:
    """The automaton as tables over (function of a stretch so far, class of the next byte), and over (state, class).

    Classes from _KINDS on are those of a text's first byte, which is read as if after no letter.
    """
    step = [row + _NEXT[0] for row in _NEXT]
    begins = [row + _BEGINS[0] for row in _BEGINS]
    ends = [row + _ENDS[0] for row in _ENDS]
    known, todo, rows = {tuple(range(_STATES)): 0}, [tuple(range(_STATES))], []
    for f in todo:  # grows while it is read: all functions that stretches of bytes can be
        row = []
        for c in range(2 * _KINDS):
            g = tuple(step[s][c] for s in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
            row.append((known[g] * 2 * _KINDS, sum(begins[s][c] << 8 * k for k, s in enumerate(f)), sum(ends[s][c] << k for k, s in enumerate(f))))
        rows += row
    function, units, marked = (np.array(x) for x in zip(*rows, strict=True))
    flat = lambda x, kind: np.array(x, kind).ravel()
    return function.astype(np.uint16), units.astype(np.uint32), marked.astype(np.uint8), np.array(todo, np.uint8), flat(step, np.uint8) * np.uint8(2 * _KINDS), flat(begins, bool), flat(ends, bool)


_FUNCTION, _UNITS, _MARKED, _FUNCTIONS, _STEP, _BEGIN, _END = _compiled()


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte; texts begin at `starts`."""
    found = _CLASS[raw]
    found[starts[starts < len(raw)]] += _KINDS
    return found


def _columns(symbols: np.ndarray) -> np.ndarray:
    """Blocks as rows, transposed: the j-th row has the j-th byte of every block. Filled with what neither moves nor counts."""
    padded = np.full(-(-len(symbols) // _WIDTH) * _WIDTH, 5, np.uint8)
    padded[: len(symbols)] = symbols
    return np.ascontiguousarray(padded.reshape(-1, _WIDTH).T)


def maps(symbols: np.ndarray) -> Map:
    """The map of each block."""
    columns = _columns(symbols)
    f, units, marked = np.zeros(columns.shape[1], np.uint16), np.zeros(columns.shape[1], np.uint32), np.zeros(columns.shape[1], np.uint8)
    for column in columns:
        at = f + column
        units += _UNITS[at]
        marked |= _MARKED[at]
        f = _FUNCTION[at]
    by = np.arange(_STATES)
    return Map(_FUNCTIONS[f // (2 * _KINDS)], (units[:, None] >> 8 * by & 255).astype(np.int64), (marked[:, None] >> by & 1).astype(bool))


def scan(symbols: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin and where control strings end, as flags of each byte, of bytes that start in `state`."""
    of = maps(symbols).ends.tolist()
    entry = []
    for ends in of:
        entry.append(state)
        state = ends[state]
    columns = _columns(symbols)
    begins, ends = np.empty(columns.shape, bool), np.empty(columns.shape, bool)
    now = np.array(entry, np.uint8) * np.uint8(2 * _KINDS)
    for j, column in enumerate(columns):
        at = now + column
        begins[j], ends[j], now = _BEGIN[at], _END[at], _STEP[at]
    flat = lambda x: x.T.reshape(-1)[: len(symbols)]
    return flat(begins), flat(ends)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of a document, from its id alone; a null id is hashed as no digits."""
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def cuts(doc_id: int | None, n: int) -> tuple[int, int]:
    """Units before the middle and before the suffix, of a text of n units."""
    a, b = (h % (n + 1) for h in draws(doc_id)[:2])
    return min(a, b), max(a, b)


def form_of(doc_id: int | None, n: int, marked: bool) -> str:
    """`plain`, `psm` or `spm`."""
    _, _, h3, h4 = draws(doc_id)
    if not n or marked or h3 % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero(_CLASS[np.frombuffer(raw, np.uint8)] != 5))


def render(text: bytes, form: str, n: int, at: tuple[int, int] | None) -> dict:
    """A row of OUT: the text cut at two bytes and put together as its form says."""
    if form == "plain" or at is None:
        return {"n_units": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text.decode()}
    prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    parts = (marks[0], prefix, marks[1], suffix, marks[2], middle) if form == "psm" else (marks[1], suffix, marks[0], prefix, marks[2], middle)
    return {"n_units": n, "form": form, "prefix_chars": _chars(prefix), "middle_chars": _chars(middle), "output": b"".join(parts).decode()}


def rearranged(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Rows of OUT of short texts, read together."""
    low = int(offsets[0])
    at = offsets - low
    begins, ends = scan(classes(data[low : offsets[-1]], at[:-1][np.diff(at) > 0]))
    places = np.flatnonzero(begins)
    first = np.searchsorted(places, at)
    marks = np.searchsorted(np.flatnonzero(ends), at)
    edge = np.append(places, at[-1])
    out = []
    for k, doc_id in enumerate(ids):
        n = int(first[k + 1] - first[k])
        form = form_of(doc_id, n, bool(marks[k + 1] > marks[k]))
        # A unit ends where the next one begins, be it the next text's first.
        two = None if form == "plain" else tuple(int(edge[first[k] + c]) if c < n else int(at[k + 1]) for c in cuts(doc_id, n))
        text = data[offsets[k] : offsets[k + 1]].tobytes()
        out.append(render(text, form, n, two and (two[0] - int(at[k]), two[1] - int(at[k]))))
    return out


def _edges(raw: np.ndarray, chunk: int) -> list[int]:
    """Where the chunks of a text begin and end: at multiples of `chunk` bytes, moved back to the beginning of a code point."""
    edges = [*range(0, len(raw), chunk), len(raw)]
    for k in range(1, len(edges) - 1):
        while _CLASS[raw[edges[k]]] == 5:
            edges[k] -= 1
    return edges


def _emitted(giants: DataFrame, chunk: int) -> DataFrame:
    """`fim_key, part, ends, units, marked`: the map of each chunk of each text, once for equal texts."""
    session = giants.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for k, key in enumerate(batch.column("fim_key").to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]]
                edges = _edges(raw, chunk)
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([p], pa.int32()), pa.array([raw[a:b].tobytes()], pa.binary())], ["fim_key", "part", "bytes"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps_of = [maps(_CLASS[np.frombuffer(b.as_buffer(), np.uint8)]).whole() for b in batch.column("bytes")]
            arrays = [pa.array([m.ends.tolist() for m in maps_of], pa.list_(pa.int32())), pa.array([m.units.tolist() for m in maps_of], pa.list_(pa.int64())), pa.array([m.marked.tolist() for m in maps_of], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("fim_key"), batch.column("part"), *arrays], ["fim_key", "part", "ends", "units", "marked"])

    parts = giants.select("fim_key", "text").mapInArrow(deal, "fim_key string, part int, bytes binary")
    parts = parts.repartition(int(session.conf.get("spark.sql.shuffle.partitions")))  # a giant's chunks go to all tasks
    emitted = parts.mapInArrow(emit, "fim_key string, part int, ends array<int>, units array<long>, marked array<boolean>")
    return emitted.groupBy("fim_key", "part").agg(F.any_value("ends").alias("ends"), F.any_value("units").alias("units"), F.any_value("marked").alias("marked"))


def _composed(emitted: DataFrame) -> DataFrame:
    """`fim_key, fim_n, fim_marked, fim_entry, fim_before`: a text's units and marks, state and units before each of its chunks.

    A text is a string of 2 GB at most, so its list of maps is bounded (32,768 at 64 KB a chunk).
    """
    lists = emitted.groupBy("fim_key").agg(F.sort_array(F.collect_list(F.struct("part", "ends", "units", "marked"))).alias("maps"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for told in batch.column("maps").to_pylist():
                state, n, marked, entry, before = 0, 0, False, [], []
                for m in told:
                    entry.append(state)
                    before.append(n)
                    n, marked, state = n + m["units"][state], marked or m["marked"][state], m["ends"][state]
                rows.append((n, marked, entry, before))
            n, marked, entry, before = zip(*rows, strict=True) if rows else ((),) * 4
            arrays = [batch.column("fim_key"), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(entry, pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["fim_key", "fim_n", "fim_marked", "fim_entry", "fim_before"])

    return lists.mapInArrow(compose, "fim_key string, fim_n long, fim_marked boolean, fim_entry array<int>, fim_before array<long>")


def select(raw: np.ndarray, unit: int, n: int, entry: list[int], before: list[int], chunk: int) -> int:
    """Byte where a unit of a giant text begins (its end for unit n): only the chunk that has the unit is read."""
    if unit >= n:
        return len(raw)
    p = int(np.searchsorted(before, unit, "right")) - 1
    a, b = _edges(raw, chunk)[p : p + 2]
    return a + int(np.flatnonzero(scan(_CLASS[raw[a:b]], entry[p])[0])[unit - before[p]])


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`docs` with `n_units`, `form`, `prefix_chars`, `middle_chars` and `output`.

    Two cuts between units, from the id's hash, part a text in prefix, middle and suffix (each may be
    empty); `psm` writes prefix, suffix, middle, `spm` suffix, prefix, middle, each behind its mark.
    `plain` is the text as it is, with null lengths: a tenth of the documents, and all whose text is
    null, empty or has a mark in it. Lengths are in code points. Rows are looked at one by one, so
    repeated rows give equal rows and an empty table an empty one; a null id is hashed as no digits.
    All columns pass through; those named like the new ones are replaced.

    Texts above `chunk` bytes take the way over chunks, equal ones together; the result is the same.
    """
    docs, back = set_aside(docs.drop(*OUT.names), ("fim_key", "fim_n", "fim_marked", "fim_entry", "fim_before"))
    names, out = [*docs.columns, *OUT.names], T.StructType([*docs.schema.fields, *OUT.fields])
    kind = pa.schema([("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in spans_of(offsets, SLICE):
                told = pa.RecordBatch.from_pylist(rearranged(ids[low:high], data, offsets[low : high + 1]), kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *told.columns], names)

    def giant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for k in range(batch.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                doc_id, n, marked, entry, before = (batch.column(c)[k].as_py() for c in ("doc_id", "fim_n", "fim_marked", "fim_entry", "fim_before"))
                form = form_of(doc_id, n, marked)
                two = None if form == "plain" else tuple(select(raw, c, n, entry, before, chunk) for c in cuts(doc_id, n))
                told = pa.RecordBatch.from_pylist([render(raw.tobytes(), form, n, two)], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in names[: -len(OUT)]), *told.columns], names)

    is_giant = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    giants = docs.filter(is_giant).withColumn("fim_key", F.sha2("text", 256))
    giants = giants.join(_composed(_emitted(giants, chunk)), "fim_key").mapInArrow(giant, out)
    return docs.filter(~is_giant).mapInArrow(short, out).unionByName(giants).withColumnsRenamed(back)


def restored(form: str = "form", output: str = "output"):
    """The text that an output was made of: parts between the marks, which no rearranged text has in itself."""
    form, output = F.col(form), F.col(output)
    part = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    head = part(output, MIDDLE, 1)
    psm = F.concat(part(part(head, SUFFIX, 1), PREFIX, 2), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text rearranged, with digests of the output and of the text that is read back from it."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), n AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
