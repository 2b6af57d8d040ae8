"""Text quality: an additive model with pairwise interactions over counted features of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam
from .common import fold_of, held_out, sample_ids, saved, spans_of, utf8
from .words import word_hashes

#: Labelled rows fitted on at most; decision.
SAMPLE, CUT = 20_000, 0.3
FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "blank", "mark", "shout", "bar", "symbol", "beyond_ascii",
    "lines", "word_length", "distinct", "top_word", "repeated", "short_words",
)
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?", b"!", b"|", b"#$%&*+/<=>@\\^_`~[]{}()\"'-", bytes(range(128, 256)), b"\n")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each of some consecutive texts; an empty text's are all 0."""
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    n = np.diff(at).astype(float)
    counts = []
    for chars in _CLASSES:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        counts.append(np.diff(np.concatenate([[0], np.cumsum(table[raw])])[at]).astype(float))
    upper, lower, digit, blank, mark, shout, bar, symbol, beyond, lines = counts
    words, first = word_hashes(data, offsets)
    n_words = np.diff(first).astype(float)
    same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    repeated = np.diff(np.concatenate([[0], np.cumsum(same)])[first]).astype(float)
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for k in np.flatnonzero(n_words):
        ordered = np.sort(words[first[k] : first[k + 1]])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        runs = np.diff(edge)
        distinct[k], top[k] = len(runs), runs.max()
    size, many = np.maximum(n, 1), np.maximum(n_words, 1)
    letters = np.maximum(upper + lower, 1)
    inside = (n - blank) / many
    return np.column_stack([
        np.log1p(n), np.log1p(n_words), upper / letters, digit / size, blank / size, mark / many, shout / many, bar / many, symbol / size, beyond / size,
        lines / many, inside, distinct / many, top / many, repeated / many, n_words / size,
    ])


def with_features(docs: DataFrame) -> DataFrame:
    """`doc_id, x`: the features of every row of `docs`, whole texts. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = [features(data, offsets[low : high + 1]) for low, high in spans_of(offsets, 1 << 20)]
            x = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, len(FEATURES)), np.float32)
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> gam.Gam:
    """A model from features and at most `sample` labelled ids, those of the lowest hash; rows without id or label are left out.

    An id with a label is one example, whatever rows of `features` or `labels` repeat it; of several
    texts under one id the one with the least features counts. So the driver gets `sample` rows at
    most. Equal hashes go by id and label. Without rows the model gives 0.5 to every text.
    """
    picked = sample_ids(labels, label, sample, 1)
    # Bounded by `sample`, before the join and, as rows of an id become one, after it.
    rows = features.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id", "label").collect()
    return gam.fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def score(features: DataFrame, model: gam.Gam) -> DataFrame:
    """`doc_id, score` of every row, repeated ones too, by vectorised additions of looked-up bins. Equal texts get equal scores."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.predict(x))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality of every document, learnt from labels outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of(5) != 0)
    # One pass over the texts; fitting and scoring read the small table of features.
    table = saved(with_features(docs), "quality-features")
    scored = score(table, fit(table, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
