"""Periodic runs of words, found by bit-parallel lags.

Word ids are written as bit planes: plane b has bit i set if bit b of word i's id is. A plane XORed
with itself shifted by a lag, ORed over all planes, has a zero wherever a word equals the word a lag
on; shift-doubling ANDs isolate the stretches of zeros that are long enough for a run of that lag.

Not every lag is worth a pass over all words. A run of period q has q consecutive zeros at least, so
for lags from 2w to 4w it has w of them from a multiple of w on: hashes of w words, taken only there,
say which lags to look at and where (a hash can only add a place to look at). Each octave of lags
costs time in proportion to the words, whatever the length of the text. Places inside a known run
whose period divides the lag are left out, as a lag of several periods finds just that run again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spans_of, utf8
from .words import mix

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Lags below it are looked for among all words. From it on two periods are LEAST_WORDS or more, so a run has as many zeros as its lag.
SHORT = 8
#: Bytes of text whose words are looked at together; bytes that are split into words at once.
SLICE, PIECE = 1 << 20, 4 << 20
#: Comparisons of hashes at a time.
_AT_ONCE = 1 << 22

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RUNS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PIECE bytes: a very long text is never a list of all its words."""
    low = 0
    while low < len(text):
        gap = _SPACE.search(text, low + PIECE)
        high = gap.start() if gap else len(text)
        yield text[low:high].split()
        low = high


class Planes:
    """Bit planes of a sequence of ids."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        bits = int(ids.max()).bit_length() if self.n else 0
        self.rows = [np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(max(1, bits))]

    def stretches(self, lag: int, low: int, high: int, least: int) -> list[tuple[int, int]]:
        """Stretches (first place, one past the last) of `least` places or more in `low..high` whose words equal those `lag` on; low is a multiple of 8."""
        if high - low < least:
            return []
        mask, off, found = (1 << (high - low)) - 1, 0, 0
        for k, row in enumerate(self.rows):
            plane = int.from_bytes(row[low >> 3 : (high + lag + 7) >> 3], "little")
            off |= plane ^ (plane >> lag)
            if k % 4 == 3 or k == len(self.rows) - 1:  # most lags are out after few planes
                found = isolated(~off & mask, least)
                if not found:
                    return []
        return [(low + a, low + b + least) for a, b in zip(places(found & ~(found << 1)), places(found & ~(found >> 1)), strict=True)]


def isolated(zeros: int, least: int) -> int:
    """Bits from which on `least` bits are set, by doubling shifts."""
    have = 1
    while have < least and zeros:
        step = min(have, least - have)
        zeros &= zeros >> step
        have += step
    return zeros


def places(bits: int) -> list[int]:
    """Numbers of the set bits, ascending."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) >> 3, "little"), np.uint8)
    at = np.flatnonzero(raw)
    byte, bit = np.nonzero(np.unpackbits(raw[at][:, None], axis=1, bitorder="little"))
    return (at[byte] * 8 + bit).tolist()


def _lags(hashes: np.ndarray, w: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (multiples of w) and lags from 2w below 4w, `top` at most, of equal hashes of w words; places ascend."""
    n, width = len(hashes), min(2 * w, top - 2 * w + 1)
    if n <= 2 * w or width < 1:
        return
    late = np.concatenate([hashes[2 * w :], np.zeros(width, np.uint64)])
    rows = -(-(n - 2 * w) // w)
    view = np.lib.stride_tricks.sliding_window_view(late, width)[::w][:rows]
    step = max(1, _AT_ONCE // width)
    for low in range(0, rows, step):
        part = view[low : low + step]
        at, lag = np.nonzero(part == hashes[low * w : low * w + len(part) * w : w][: len(part), None])
        yield (at + low) * w, lag + 2 * w


def find(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of ids, by start and period.

    `longest` bounds the length of a run if it is known (of several texts, that of the longest).
    """
    planes, n = Planes(ids), len(ids)
    top = min(longest or n, n) // LEAST_PERIODS
    known: dict[tuple[int, int], int] = {}

    def take(lag: int, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:  # of lags with the same stretch the first is the least
            known.setdefault((a, b - a + lag), lag)

    for lag in range(1, min(SHORT - 1, top) + 1):
        take(lag, planes.stretches(lag, 0, n - lag, max(LEAST_WORDS - lag, lag)))
    w, hashes = 1, mix(ids.astype(np.uint64) + np.uint64(1))
    while 2 * w <= top:
        if 2 * w >= SHORT:
            long = [(s, s + m, p) for (s, m), p in known.items() if m >= 3 * w]
            looked: list[tuple[np.ndarray, np.ndarray]] = []
            for at, lag in _lags(hashes, w, top):
                new = np.ones(len(at), bool)
                for s, e, p in long if len(at) else ():
                    i, j = np.searchsorted(at, s), np.searchsorted(at, e - 3 * w, "right")
                    if i < j:
                        new[i:j] &= (lag[i:j] % p != 0) | (at[i:j] + lag[i:j] + w > e)
                looked.append((at[new], lag[new]))
            at, lag = (np.concatenate(x) for x in zip(*looked, strict=True)) if looked else (np.zeros(0, int),) * 2
            by = np.lexsort((at, lag))
            at, lag = at[by], lag[by]
            # Places of one lag that are near each other are one stretch of the planes.
            new = np.flatnonzero((np.diff(lag, prepend=-1) != 0) | (np.diff(at, prepend=0) > 8 * lag + 1024))
            for a, b in zip(new, np.append(new, len(at))[1:], strict=True):
                take(int(lag[a]), _around(planes, int(lag[a]), int(at[a]), int(at[b - 1]) + w))
        if n <= 2 * w:
            break
        hashes = mix(hashes[:-w] * _STEP + hashes[w:])
        w *= 2
    return sorted((s, m, p) for (s, m), p in known.items())


def _around(planes: Planes, lag: int, first: int, last: int) -> list[tuple[int, int]]:
    """Whole stretches of `lag` near the places from `first` to `last`: the view grows until none touches its edges."""
    reach, end = 2 * lag, planes.n - lag
    while True:
        low, high = max(0, first - reach) & ~7, min(end, last + reach)
        found = planes.stretches(lag, low, high, lag)
        if not any((a == low and low) or (b == high and high < end) for a, b in found):
            return found
        reach *= 4


def runs_of(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs, and the text without a run's repeats, of each text.

    The texts are one sequence, parted by ids that occur once, so no run reaches over an edge.
    """
    known: dict[bytes, int] = {}
    parts, first = [], [0]
    for text in texts:
        ids = [np.array([known.setdefault(x, len(known)) for x in piece], np.int64) for piece in pieces(text)]
        parts += [*ids, np.array([-1])]
        first.append(first[-1] + sum(map(len, ids)) + 1)
    ids, edge = np.concatenate(parts), np.array(first)
    ids[edge[1:] - 1] = len(known) + np.arange(len(texts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(np.diff(edge).max()) - 1
    if longest >= LEAST_WORDS:
        for s, m, p in find(ids, longest):
            d = int(np.searchsorted(edge, s, "right")) - 1
            found[d].append((s - first[d], m, p))
    for d, text in enumerate(texts):
        n = first[d + 1] - first[d] - 1
        keep = np.ones(n, bool)
        for s, m, p in found[d]:
            keep[s + p : s + m] = False
        left, at = [], 0
        for piece in pieces(text):
            left += [b" ".join(compress(piece, keep[at : at + len(piece)].tolist()))]
            at += len(piece)
        yield n, found[d], b" ".join(x for x in left if x)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """`docs` with `n_words`, `runs` and `collapsed`: each text's words without what repeats a run's first period, joined by one space.

    A run is a stretch of consecutive words (ASCII white space parts them) with smallest period q, of
    LEAST_WORDS and LEAST_PERIODS * q words at least, that no neighbouring word extends. Runs may
    overlap; all are listed, by start and period. Null and empty texts have no words, no runs and an
    empty `collapsed`. Rows are looked at one by one: repeated rows and null ids stay as they are, an
    empty table gives an empty one. All columns pass through; those named like the new ones are replaced.
    """
    docs = docs.drop(*RUNS.names)
    names = [*docs.columns, *RUNS.names]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in spans_of(offsets, SLICE):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1], strict=True)]
                n, runs, left = zip(*runs_of(texts), strict=True)
                told = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in runs]
                arrays = [*batch.slice(low, high - low).columns, pa.array(n, pa.int64()), pa.array(told, kind), pa.array([x.decode() for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RUNS.fields]))


def repeat_tail(doc_id: int | None, text: bytes) -> bytes:
    """A tenth of the texts, by hash of the id, ends in repeats of words from a place on; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return text
    inside = _IN_WORD[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n, g = len(starts), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    whole = text[starts[a] : ends[a + p - 1]] + b" "
    return text[: starts[a]] + whole * times + (text[starts[a] : ends[a + rest - 1]] if rest else b"")


def with_tails(docs: DataFrame) -> DataFrame:
    """`doc_id, text` with the repeats that the query asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in spans_of(offsets, SLICE):
                texts = [repeat_tail(ids[k], data[offsets[k] : offsets[k + 1]].tobytes()).decode() for k in range(low, high)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the runs of every whole text, a tenth of them with planted repeats, as counts, the longest run and digests."""
    found = collapse_runs(with_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("best")["length"], -F.col("best")["col2"], -F.col("best")["col3"]
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
