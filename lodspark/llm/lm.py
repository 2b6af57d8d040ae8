"""Language-model scores of documents: word-unigram base and subword-lattice likelihood, learnt from training documents.

A word's probability is the sum over all its segmentations into pieces of the vocabulary, whose
weights are fitted to the training words as often as they occur. With `whole_words` a word of training
also has an arc over all of it: its count less a discount, and what the discount frees is shared out
by the pieces. Either way the chances of all words add up to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import fold_of, held_out, saved, workspace
from .tokens import tokenizer_path

#: Most frequent words that are broadcast and their bytes at most (a bound of 8 MB of words, whatever the
#: corpus), words a task counts before it hands them on, rounds of expectation-maximisation, uses added to
#: each piece.
COMMON, COMMON_BYTES, HELD, ROUNDS, EXTRA = 1 << 17, 64, 200_000, 3, 0.1
_LN10 = float(np.log(10))


def word_counts(docs: DataFrame) -> DataFrame:
    """`word, c` over all `docs`: lower-cased (A-Z) runs without ASCII white space, as bytes. Added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update((text.as_py() or b"").lower().split())
                if len(held) >= HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    def out(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


class Chances:
    """log10 probability of words: discounted training counts, and the lattice of pieces for the rest; without `whole_words`, the lattice alone."""

    def __init__(self, pieces: lattice.Lattice, words: int, distinct: int, once: int, twice: int, whole_words: bool = True):
        self.pieces, self.words, self.whole_words = pieces, max(words, 1), whole_words
        self.discount = (once + 1) / (once + 2 * twice + 2)
        self.rest = float(np.log(self.discount * distinct / words)) if words else 0.0

    def of(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        if not self.whole_words:
            return self.pieces.run(words) / _LN10
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(counts - self.discount, 0) / self.words)
        return np.logaddexp(own, self.rest + self.pieces.run(words)) / _LN10


def fit(counts: DataFrame, pieces: list[bytes], rounds: int = ROUNDS, by_count: bool = False) -> lattice.Lattice:
    """Piece weights from the distinct words: each round adds up, over all segmentations of all words, how often pieces are used.

    Each word counts once where the pieces answer for words that counts don't tell about; with
    `by_count`, as often as training has it, which is right where they answer for all words.
    """
    model = lattice.Lattice(pieces, lattice.first_weights(pieces))
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(shared.value.weights.shape)
            for batch in batches:
                shared.value.run(batch.column("word").to_pylist(), uses, batch.column("c").to_numpy().astype(float) if by_count else np.ones(len(batch)))
            at = np.flatnonzero(uses.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses.ravel()[at])], ["at", "uses"])

        # One row a weight: four times the vocabulary at most.
        rows = counts.mapInArrow(run, "at long, uses double").groupBy("at").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(model.weights.size)
        uses[rows["at"].to_numpy()] = rows["uses"].to_numpy()
        model = lattice.Lattice(pieces, lattice.normalised(uses.reshape(model.weights.shape), EXTRA))
    return model


def with_chance(counts: DataFrame, model: Chances) -> DataFrame:
    """`word, c, chance`: each counted word with the log10 of its marginal probability."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = shared.value.of(batch.column("word").to_pylist(), batch.column("c").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(chance)], ["word", "c", "chance"])

    return counts.mapInArrow(run, "word binary, c long, chance double")


def score(docs: DataFrame, train: DataFrame, pieces: list[bytes] | None = None, common: int = COMMON, whole_words: bool = False) -> DataFrame:
    """`doc_id, n_tokens, n_known, train_tokens, base_score, score` of every row of `docs`, learnt from `train`; a table written when this returns.

    A text's tokens are its words and one end. Counts of the `common` most frequent words of at most
    COMMON_BYTES travel to every task; the others of a text (few, and none of them frequent, or else
    few in a text of some size) meet their counts in a join by word. Words of any length are scored
    whole, in memory that does not grow with them. Every row has its score: repeated rows and null ids
    too, and in `train` each row counts. Null and empty texts have the end alone. Without training
    documents all words are unknown and pieces keep the weights of their order in the vocabulary.
    """
    with workspace(docs.sparkSession, "lm") as folder:
        return saved(_scored(docs, train, pieces or lattice.vocabulary(tokenizer_path()), common, whole_words, folder), "lm-scores")


def _scored(docs: DataFrame, train: DataFrame, pieces: list[bytes], common: int, whole_words: bool, folder: str) -> DataFrame:
    spark = docs.sparkSession
    counted = saved(word_counts(train), "lm-counts", f"{folder}/counts")
    ends = train.count()
    sums = counted.agg(F.sum("c").alias("n"), F.count("c").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()[0]
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    model = Chances(fit(counted, pieces, by_count=not whole_words), sums.n or 0, sums.v, sums.once, sums.twice, whole_words)
    known = saved(with_chance(counted, model), "lm-chances", f"{folder}/chances")
    top = known.filter(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("c"), "word").limit(common).toArrow()
    words = {w: k for k, w in enumerate(top["word"].to_pylist())}
    shared = spark.sparkContext.broadcast((words, top["c"].to_numpy().astype(float), top["chance"].to_numpy(), model))
    floor = total + 0.5 * (distinct + 1)
    p_end = (ends + 0.5) / (total + 1)
    go_on, end = float(np.log10(1 - p_end)), float(np.log10(p_end))
    base_end = float(np.log10((ends + 0.5) / floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts, chances, _ = shared.value
        base = np.log10((counts + 0.5) / floor)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = Counter((text.as_py() or b"").lower().split())
                at, n, rare = [], [], []
                for w, k in own.items():
                    p = place.get(w)
                    if p is None:
                        rare.append((w, k))
                    else:
                        at.append(p)
                        n.append(k)
                a, m = np.array(at, np.int64), np.array(n, float)
                size = sum(own.values())
                rows.append((size + 1, int(m.sum()) + (ends > 0), float(m @ base[a]) + base_end, float(m @ chances[a]) + size * go_on + end, [w for w, _ in rare], [k for _, k in rare]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "words", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    # Written once: the same rows give the frequent part and the words to look up.
    rows = saved(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<int>"), "lm-rows", f"{folder}/rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(known, "word", "left").select("row", "times", "c", "chance", F.when(F.col("chance").isNull(), F.col("word")).alias("word"))

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = batch.column("chance").to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(np.isnan(chance))
            words = batch.column("word").take(pa.array(new)).to_pylist()
            chance[new] = shared.value[3].of(words, np.zeros(len(words)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("times"), batch.column("c"), pa.array(chance)], ["row", "times", "c", "chance"])

    met = met.mapInArrow(unknown, "row long, times int, c long, chance double")
    c = F.coalesce("c", F.lit(0))
    parts = met.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(c > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"), (F.col("times") * F.log10((c + 0.5) / floor)).alias("base_score"), (F.col("times") * F.col("chance")).alias("score"))
    both = rows.select(parts.columns).unionByName(parts)
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's scores, learnt from the documents outside fold 1 of 5; the score is the lattice's alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, docs.filter(fold_of(5) != 1))
    return scored.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
