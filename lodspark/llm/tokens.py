"""Token-id files: public tokenizer ids under a canonical length-limited Huffman code.

Layout of a token folder, all in Parquet so that any store Spark reads will do:

- `codes`: `id, length, vocabulary, stride` - the code book, from counts over all documents;
- `blocks`: `shard, block, before, n_ids, doc_ids, lengths, byte_at, marks, bits` - independent
  blocks of whole documents in ascending doc_id. `bits` holds each document from a whole byte
  (`byte_at`) on, `marks` the bit, in its document, of every stride-th id after the first, so a block decodes in
  many runs at once; `before` counts the ids of earlier blocks of the shard.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, scratch, utf8, workspace
from .huffman import Code, code_lengths

#: Tokenizer file, end id, longest code, ids in a block, ids between checkpoints, bytes of ids (two each) in a shard.
TOKENIZER, END_ID, LIMIT, BLOCK_IDS, STRIDE, SHARD_BYTES = "word_bpe_49k.json", 1, 18, 1 << 18, 256, 128 << 20
_CACHE = 250_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file; the driver needs no more of it."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return 1 + max([*file["model"]["vocab"].values(), *[t["id"] for t in file["added_tokens"]]])


class WordEncoder(dict):
    """Ids of white-space separated words, as little-endian 16-bit bytes; two generations bound the cache.

    This tokenizer drops white space and never joins tokens across it, so a text's ids are those of
    its words in order. A word of Latin letters and then marks is the library's model applied to
    each of the two runs; any other word goes through the whole library tokenizer.
    """

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each worker process, kept between tasks."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = self.older_runs.get(run)
            if ids is None:
                shown = run if run.isascii() else "".join(map(self.shown.__getitem__, run.encode()))
                ids = np.array([t.id for t in self.model.tokenize(shown)], "<u2").tobytes()
            if len(self.runs) >= _CACHE:
                self.older_runs, self.runs = self.runs, {}
            self.runs[run] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            plain = self._PLAIN.fullmatch(text)
            if plain:
                ids = self._run(plain[1].lower()) + (self._run(plain[2]) if plain[2] else b"")
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


def encode_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """`doc_id, ids`: the ids of each whole text and the end id, as little-endian 16-bit numbers. Null text is empty."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or b"") + end for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _count(staged: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id over all documents: one row an id and task, summed on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, at = utf8(batch.column("ids"))
            total += np.bincount(np.ascontiguousarray(data[at[0] : at[-1]]).view("<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


_BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<int>, byte_at array<int>, marks array<array<int>>, bits binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, stride: int = STRIDE) -> None:
    """Write the ids of all `docs` (doc_id, text) as a token folder at `path`.

    Rows are dealt to ranges of (doc_id, hash of the ids, row): rows that share an id, or are repeats
    of one another, are split as well, and a shard holds about SHARD_BYTES of ids however many there
    are. Null text is empty and gives the end id alone; null ids come first; repeated ids are kept, each
    a document, in the order of their hashes; an empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    size = vocabulary_size(tokenizer)
    with workspace(spark, "token-ids") as folder:
        # The only pass through the tokenizer; counts and codes both read what it wrote.
        staged = saved(encode_ids(docs, tokenizer, end_id), "token-ids", f"{folder}/ids")
        counts = _count(staged, size)
        lengths = code_lengths(counts, LIMIT)
        used = np.flatnonzero(lengths)
        book = pa.table({"id": used.astype(np.int32), "length": lengths[used].astype(np.int32)})
        spark.createDataFrame(book.to_pandas(), "id int, length int").withColumns({"vocabulary": F.lit(size), "stride": F.lit(stride)}).coalesce(1).write.parquet(f"{path}/codes")
        shared = spark.sparkContext.broadcast(Code(lengths))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) * 2 // SHARD_BYTES + 1)
        keyed = staged.withColumns({"h": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
        keys = ["doc_id", "h", "row"]
        placed = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, block, before, names, held, count = TaskContext.get().partitionId(), 0, 0, [], [], 0

            def flush() -> pa.RecordBatch:
                first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                raw, start, at = shared.value.encode(np.concatenate(held), first)
                marks = [(at[a + stride : b : stride] - s * 8).astype(np.int32) for a, b, s in zip(first[:-1], first[1:], start, strict=False)]
                values = [shard, block, before, count, names, np.diff(first).tolist(), start[:-1].tolist(), [m.tolist() for m in marks], raw]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

            for batch in batches:
                for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    ids = np.frombuffer(x.as_py(), "<u2")
                    if held and count + len(ids) > block_ids:
                        yield flush()
                        block, before, names, held, count = block + 1, before + count, [], [], 0
                    names.append(name)
                    held.append(ids)
                    count += len(ids)
            if held:
                yield flush()

        placed.mapInArrow(pack, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids` of a token folder; `ids` are little-endian unsigned 32-bit numbers, `start` counts the ids of all documents before."""
    codes = spark.read.schema("id int, length int, vocabulary int, stride int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(codes[0].vocabulary if codes else 1, np.uint8)
    for row in codes:
        lengths[row.id] = row.length
    stride = codes[0].stride if codes else 1
    shared = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard.
    offsets = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], np.int64)
                marks = [np.concatenate([[0], m]).astype(np.int64) + b * 8 for m, b in zip(row["marks"], row["byte_at"], strict=True)]
                runs = np.array([len(m) for m in marks])
                first = np.concatenate([[0], np.cumsum(n)])
                at, of = np.concatenate(marks), np.repeat(np.arange(len(n)), runs)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(runs) - runs, runs)
                size = np.minimum(stride, n[of] - nth * stride)
                ids = code.decode(row["bits"], at, size).astype("<u4")
                raw = [ids[first[k] : first[k + 1]].tobytes() for k in range(len(n))]
                start = first[:-1] + row["before"] + row["offset"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(n), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(offsets, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokenized(docs: DataFrame) -> DataFrame:
    """Write all documents' ids, read them back: `doc_id, start, n_tokens, ids_crc32`."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path)
    back = read_tokens(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: token ids of all documents, read back from the token folder."""
    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
