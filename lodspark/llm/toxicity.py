"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of 3, 5, 7 and 8 characters are hashed to buckets. Over a bounded, labelled sample the
cluster counts in how many toxic and other texts each bucket occurs; the buckets that tell the
classes apart best (8192 of those in five texts or more) become features, whose value in a text is
the log of the ratio of the two smoothed shares if the text has it, else 0. A regularised logistic
model weights them; it is fitted on one bitmap of features a text, so the driver gets at most
SAMPLE * FEATURES / 8 bytes (25 MB) whatever the texts hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, held_out, sample_ids, saved, spans_of, utf8, workspace
from .words import mix

#: Labelled rows fitted on at most, n-gram sizes, hash bits, features, fewest texts of a feature, penalty, decision.
SAMPLE, SIZES, BITS, FEATURES, LEAST, PENALTY, CUT = 24_000, (3, 5, 7, 8), 20, 8192, 5, 1.0, 0.3

_lower: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    """Code point -> code point in lower case; white space -> blank."""
    if not _lower:
        table = np.arange(0x110000, dtype=np.uint64)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            if x.isspace():
                table[c] = 32
            elif x.isupper() and len(x.lower()) == 1:
                table[c] = ord(x.lower())
        _lower.append(table)
    return _lower[0]


def buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket of every n-gram of consecutive texts, and the text it lies in."""
    raw = data[offsets[0] : offsets[-1]]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
    s = _lower_table()[chars]
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    step = np.uint64(0x9E3779B97F4A7C15)
    for size in SIZES:
        if len(s) < size:
            continue
        n = len(s) - size + 1
        h = s[:n] + np.uint64(size)
        for k in range(1, size):
            h = h * step + s[k : k + n]
        inside = of[:n] == of[size - 1 :]
        yield (mix(h) >> np.uint64(64 - bits)).astype(np.int64)[inside], of[:n][inside]


class Model:
    """Bucket -> weight, and a constant."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, constant: float):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[bucket] = np.arange(len(bucket))
        self.weight, self.constant = weight, constant

    def features(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts: their number, and the distinct (text, feature) pairs of the run, in order."""
        data, offsets = utf8(column)
        for low, high in spans_of(offsets, 1 << 19):
            found = [np.zeros(0, np.int64)]
            for bucket, of in buckets(data, offsets[low : high + 1]):
                place = self.place[bucket]
                hit = np.flatnonzero(place >= 0)
                found.append(np.unique(of[hit] * len(self.weight) + place[hit]))
            pairs = np.unique(np.concatenate(found))
            yield high - low, pairs // max(1, len(self.weight)), pairs % max(1, len(self.weight))

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability that each text is toxic."""
        sums = [np.bincount(of, self.weight[k], n) for n, of, k in self.features(column)]
        z = self.constant + (np.concatenate(sums) if sums else np.zeros(0))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit_logistic(y: np.ndarray, of: np.ndarray, feature: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by accelerated gradient descent on the penalised log loss; the constant is free.

    `of` and `feature` name the row and the feature of each pair, rows in order.
    """
    n, m = len(y), len(ratio)
    # Runs of pairs: what a step holds beside them does not grow with the sample.
    runs = [slice(at, at + (1 << 22)) for at in range(0, len(of), 1 << 22)]

    def by_row(x: np.ndarray) -> np.ndarray:
        return sum((np.bincount(of[r], x[feature[r]], n) for r in runs), np.zeros(n))

    def by_feature(x: np.ndarray) -> np.ndarray:
        return sum((np.bincount(feature[r], x[of[r]], m) for r in runs), np.zeros(m))

    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    w, b = np.zeros(m), float(np.log(mean / (1 - mean)))
    if not n or not m:
        return w, b
    squared = float(by_row(ratio * ratio).mean()) + 1
    rate = 4 / (squared + penalty)
    look_w, look_b, t = w.copy(), b, 1.0
    last = np.inf
    for _ in range(steps):
        z = by_row(ratio * look_w) + look_b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)) + penalty * (look_w @ look_w) / (2 * n))
        if loss > last:
            rate, t, look_w, look_b, last = rate / 2, 1.0, w.copy(), b, np.inf
            continue
        last = loss
        g = (p - y) / n
        new_w = look_w - rate * (ratio * by_feature(g) + penalty * look_w / n)
        new_b = look_b - rate * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY) -> Model:
    """A model from the labelled rows of `labels` (doc_id, label) and the texts of `docs`.

    At most `sample` ids are used, those of the lowest hash; whole texts are read. Rows with a null
    id or label are left out; of several texts under one id the least counts, so the bound holds for
    texts too; equal texts with equal labels count once, ids without a row of `docs` not at all.
    Without rows the model gives 0.5 to every text, with rows of one class nearly 0 or 1. Reruns agree.
    """
    with workspace(docs.sparkSession, "toxic") as folder:
        return _fit(docs, labels, label, sample, features, penalty, folder)


def _fit(docs: DataFrame, labels: DataFrame, label: str, sample: int, features: int, penalty: float, folder: str) -> Model:
    picked = sample_ids(labels, label, sample, 8)
    # The sample is bounded by `sample`, so it may be broadcast; its texts are written once and read twice.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = saved(texts.select("label", "text").distinct(), "toxic-sample", f"{folder}/sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            y = np.array(batch.column("label").to_pylist(), np.int64)
            texts += np.bincount(y, minlength=2)
            data, offsets = utf8(batch.column("text"))
            for low, high in spans_of(offsets, 1 << 19):
                # A text has a bucket once, whatever sizes of n-grams fall into it.
                pair = np.unique(np.concatenate([np.zeros(0, np.int64), *[of << BITS | bucket for bucket, of in buckets(data, offsets[low : high + 1])]]))
                at, kind = pair & ((1 << BITS) - 1), y[low:high][pair >> BITS]
                for k in (0, 1):
                    total[k] += np.bincount(at[kind == k], minlength=1 << BITS).astype(np.int32)
        used = np.flatnonzero(total.sum(0))
        rows = [used, total[0][used], total[1][used]]
        rows = [np.append(r, x) for r, x in zip(rows, (-1, *texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["bucket", "other", "toxic"])

    counts = texts.mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = saved(counts, "toxic-counts", f"{folder}/counts")
    whole = counts.filter("bucket = -1").collect()
    if not whole or not whole[0].other or not whole[0].toxic:
        share = float(whole[0].toxic > 0) if whole and whole[0].other + whole[0].toxic else 0.5
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 0.01) / (1.01 - share))))
    n0, n1 = whole[0].other, whole[0].toxic
    p, q, both = F.col("toxic") / n1, F.col("other") / n0, (F.col("toxic") + F.col("other")) / (n0 + n1)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) + 1e-9)
    chosen = counts.filter((F.col("bucket") >= 0) & (F.col("toxic") + F.col("other") >= LEAST)).withColumn("z", z).orderBy(F.desc("z"), "bucket").limit(features).orderBy("bucket").collect()
    bucket = np.array([r.bucket for r in chosen], np.int64)
    toxic, other = np.array([r.toxic for r in chosen], float) + 1, np.array([r.other for r in chosen], float) + 1
    # Log ratio of the smoothed shares of toxic and of other texts that have the n-gram.
    ratio = np.log((toxic / (n1 + 2)) / (other / (n0 + 2)))
    blank = docs.sparkSession.sparkContext.broadcast(Model(bucket, np.zeros(len(bucket)), 0.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(blank.value.weight)
        for batch in batches:
            found = []
            for n, of, k in blank.value.features(batch.column("text")):
                has = np.zeros((n, width), np.uint8)
                has[of, k] = 1
                found += [x.tobytes() for x in np.packbits(has, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "features"])

    # Rows in the order of what they hold: equal ones are the same to the fit, so reruns agree to the last digit.
    fitted = texts.mapInArrow(rows, "label int, features binary").orderBy("features", "label").toArrow()
    y, of, feature = _unpacked(fitted.column("label").to_numpy(), fitted.column("features"), len(bucket))
    weight, constant = _fit_logistic(y, of, feature, ratio, penalty)
    return Model(bucket, weight * ratio, constant)


def _unpacked(labels: np.ndarray, bitmaps: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the row and feature of each set bit, rows in order."""
    of, feature, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int16)], 0
    for part in bitmaps.chunks:
        data, offsets = utf8(part)
        bits = data[offsets[0] : offsets[-1]].reshape(len(part), -1)
        for low in range(0, len(part), 1024):
            row, k = np.nonzero(np.unpackbits(bits[low : low + 1024], axis=1, count=width))
            of.append((row + at + low).astype(np.int32))
            feature.append(k.astype(np.int16))
        at += len(part)
    return labels.astype(float), np.concatenate(of), np.concatenate(feature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every row; null texts count as empty, and empty texts get the model's constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: toxicity of every document, learnt from labels outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of(4) != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
