import zlib

import numpy as np
from test_decontam import brute as leaks
from test_neardup import brute as copies

import corpus_pipeline
from lodspark.llm import common, decontam, langid, mixing, tokens
from lodspark.llm.common import fold_of


def test_stages_equal_their_brute_force(spark, odd_rows, tmp_path):
    long = next(t for i, t, _, _ in odd_rows if i == 65)
    rows = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in odd_rows if i not in (None, 66)]
    rows += [(66, rows[0][1], "en", "s1", len(rows[0][1])), (80, " ".join(long.split()[200:260]), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, " ".join(long.split()[210:225]))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mix_sources", "token_files"]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = langid.fit(docs.filter(fold_of(3) != 1))
    kept = [r for r in rows if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= langid.MIN_SCORE]
    heads = {c for _, c, _, _ in copies([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if str(r[0]) in heads]
    clean = {i for i, _, hit, _ in leaks([(r[0], r[1]) for r in kept], items) if not hit}
    kept = [r for r in kept if r[0] in clean]
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect() if r.taken}
    encoder, want, at = tokens.WordEncoder(tokens.tokenizer_path()), [], 0
    for i, t, *_ in sorted(kept):
        ids = [*np.frombuffer(encoder.encode(t.encode()), "<u2").tolist(), 1]
        for _ in range(taken.get(i, 0)):
            want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert got == want


def test_scratch_goes_and_results_stay(spark, odd_rows, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(common, "shared_dir", lambda _: str(shared))
    long = next(t for i, t, _, _ in odd_rows if i == 65)
    spark.createDataFrame([(i, t, g, s, 1) for i, t, g, s in odd_rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(long.split()[k : k + 20])) for k in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() and sorted(p.name.rsplit("-", 1)[0] for p in shared.iterdir()) == ["pipeline-token_files", "tokens"]
    # Of the tables between passes over blocks of the benchmark the last is read by the result.
    hits = decontam.find(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block_bytes=1)
    assert hits.filter("size(spans) > 0").count() == 1 and len([p for p in shared.iterdir() if p.name.startswith("decontam-hits")]) == 1


def test_odd_and_empty_tables(spark, odd_rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    whole = [(i, t, g, s, None) for i, t, g, s in odd_rows]
    once = [r for k, r in enumerate(whole) if r[0] is not None and (r[0] != 66 or whole[k - 1][0] != 66)]
    found = {}
    for name, rows, items in (("whole", whole, [(None, None), (1, "")]), ("once", once, [(1, "no such words")]), ("empty", [], [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        found[name] = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, at).collect())
    # Rows without an id and repeated rows are copies of rows that stay.
    assert found["whole"] == found["once"] and found["once"] and not found["empty"]
