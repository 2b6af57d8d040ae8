"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams (one to three
characters) over a bounded sample of labelled documents. A document's own ranking is compared to
each profile by the out-of-place distance: how many ranks each of its n-grams is displaced, the
profile's length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, held_out, set_aside

#: Ranks in a profile; labelled documents that a language's profile is fitted on at most.
RANKS, SAMPLE = 300, 400
#: Parts in which a language's lowest hashes are looked for first.
SALTS = 16
#: The pipeline rejects documents that match no language better than this share of the worst distance.
MIN_SCORE = 0.05

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter's code point plus 1, or 0 for all that is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low[0]) + 1
        _letters.append(table)
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray:
    """Keys of all n-grams of a text, repeats included. What is no letter is one separator; both ends are separators."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letter_table()[raw]
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    s = s[keep]
    if not len(s):
        return np.zeros(0, np.int64)
    s = np.concatenate([[0], s])
    one = s[s > 0]
    two = (s[:-1] << 21 | s[1:]) | 1 << 42
    three = s[:-2] << 42 | s[1:-1] << 21 | s[2:]
    three = three[(s[1:-1] > 0)]
    return np.concatenate([one, two, three])


def _ranked(keys: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent keys, first rank first; equal counts in the order of their keys."""
    found, counts = np.unique(keys, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Rank of each n-gram in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int):
        self.ranks, self.langs = ranks, sorted({lang for lang, _, _ in rows})
        self.keys = np.unique(np.array([k for _, k, _ in rows], np.int64))
        self.table = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for lang, key, rank in rows:
            self.table[self.langs.index(lang), np.searchsorted(self.keys, key)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / worst distance; `und`, 0 without letters or languages. Ties: the first language by code point."""
        grams = _ranked(ngrams(text), self.ranks)
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, grams)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != grams)] = len(self.keys)
        ranks = self.table[:, at]
        away = np.where(ranks < 0, self.ranks, np.abs(ranks - np.arange(len(grams)))).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.ranks * len(grams)))


def fit(train: DataFrame, sample: int = SAMPLE, ranks: int = RANKS) -> Profiles:
    """Profiles from `train` (doc_id, lang, text): per language `sample` documents, or all if there are fewer, those of the lowest hash.

    Null languages and ids are left out. A document is an id in a language: repeated rows, and rows
    that share an id, count once, with their least text, so they can neither crowd out a language nor
    outgrow the sample. Only the sampled texts are read into n-grams; their counts are added up on
    the cluster and `ranks` rows a language come to the driver.
    """
    known = train.filter("doc_id is not null and lang is not null")
    hashed = known.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    # Two stages of lowest hashes: the first, dealt by salt, leaves at most `sample` rows a language and salt.
    hashed = hashed.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        order = W.partitionBy(*keys).orderBy("h", "doc_id")
        hashed = hashed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample).drop("rn")
    # Bounded by `sample` ids a language.
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(hashed.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                keys, n = np.unique(np.concatenate([ngrams(t) for g, t in zip(langs, texts, strict=True) if g == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], ["lang", "key", "n"])

    counts = texts.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "key")
    rows = counts.withColumn("rank", F.row_number().over(top) - 1).filter(F.col("rank") < ranks)
    return Profiles([(r.lang, r.key, r.rank) for r in rows.select("lang", "key", "rank").collect()], ranks)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of `docs` with the language and its score (columns `names`); one row a document, repeated rows too.

    Null and empty texts and texts without letters are `und` with score 0. Whole texts are ranked.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column(c) for c in keep] + [pa.array([a for a, _ in said], pa.string()), pa.array([b for _, b in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return docs.mapInArrow(run, out)


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pipeline stage: documents whose language is found; `und` and texts unlike every profile go. Columns stay as they are."""
    names = ("identified_lang", "identified_score")
    docs, back = set_aside(docs, names)
    train = docs.filter(fold_of(3) != 1)
    scored = predict(docs, fit(train), docs.columns, names)
    return scored.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= min_score)).select(docs.columns).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's language, learnt from the documents outside fold 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit(docs.filter(fold_of(3) != 1))
    return predict(docs, profiles, ["doc_id"]).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
