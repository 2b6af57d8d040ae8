from types import SimpleNamespace as N

import pytest

from pyspark.sql import functions as F

from lodspark.llm import common, decontam, langid, mixing, neardup


def session(master, folder=None):
    """What `shared_dir` asks of a session."""
    held = N(isDefined=lambda: False)
    context = N(master=master, setCheckpointDir=lambda _: None, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: held)))
    return N(conf=N(get=lambda key, default: folder), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert common.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("local[4]"))


def test_workspace_goes_also_after_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    with pytest.raises(ZeroDivisionError), common.workspace(spark, "w") as folder:
        common.saved(spark.range(3), "t", f"{folder}/t")
        assert len(list(tmp_path.iterdir())) == 1
        1 / 0  # noqa: B018
    assert not list(tmp_path.iterdir())


def test_stages_keep_columns_named_like_their_own(spark, odd):
    names = ["identified_lang", "Identified_Score", "kept_id", "kept_null", "kept_hash", "mix_cut", "mix_time", "n_words", "spans", "Items", "items_"]
    docs = odd.drop("n_words", "spans").select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "clean words then the leaked passage")], "item_id long, text string")
    stages = {
        "language": langid.keep_identified,
        "copies": neardup.keep_one,
        "documents": lambda d: decontam.decontaminate(d, bench),
        "spans": lambda d: decontam.decontaminate(d, bench, "spans"),
        "mix": mixing.mixed,
    }
    for stage, run in stages.items():
        out = run(docs)
        assert out.schema.simpleString() == docs.schema.simpleString(), stage
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names), stage
