import random

import pytest

from lodspark.operators.changelog import ChangeLog
from lodspark.operators.neighbourhood import best, expand
from lodspark.sources.sinks import Conflict
from pyspark.sql import functions as F

KIND = "id long, label string, size int, tags array<string>"


def test_log_equals_snapshots(spark, tmp_path):
    rng = random.Random(4)
    log, states, now = ChangeLog(spark, str(tmp_path / "log"), KIND), [{}], {}
    for version in range(1, 7):
        changes, before = [], dict(now)
        for key in rng.sample(range(12), 5):
            if rng.random() < 0.25:
                changes.append((key, None, None, None, None))
                now.pop(key, None)
            else:
                fields = rng.sample(["label", "size", "tags"], rng.randint(1, 3))
                values = {"label": rng.choice([None, f"l{version}"]), "size": rng.choice([None, version]), "tags": rng.choice([None, [f"t{version}"]])}
                changes.append((key, fields, values["label"], values["size"], values["tags"]))
                now[key] = {**now.get(key, {"label": None, "size": None, "tags": None}), **{f: values[f] for f in fields}}
        made, told = log.write(spark.createDataFrame(changes, "id long, fields array<string>, label string, size int, tags array<string>"), version - 1)
        said = {r.id: r.status for r in told.collect()}
        assert made == version and all(said[k] == ("404" if f is None and k not in before else "200" if k in before else "201") for k, f, *_ in changes)
        states.append({k: dict(v) for k, v in now.items()})
        if version == 3:
            assert log.compact() == 3 and log.compact() == 3
    for version, want in enumerate(states):
        got = {r.id: {"label": r.label, "size": r["size"], "tags": r.tags} for r in log.read(version).collect()}
        assert got == want, version
    diff = {(r.id, r.field): (r.old, r.new) for r in log.difference(2, 6).collect()}
    text = lambda v: None if v is None else f'["{v[0]}"]' if isinstance(v, list) else str(v)
    want = {}
    for key in set(states[2]) | set(states[6]):
        for f in ("label", "size", "tags"):
            a, b = states[2].get(key, {}).get(f), states[6].get(key, {}).get(f)
            if a != b or (key in states[2]) != (key in states[6]):
                want[(key, f)] = (text(a), text(b))
    assert diff == want


def test_writers_of_old_versions_meet_field_by_field(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), KIND)
    kind = "id long, fields array<string>, label string, size int"
    log.write(spark.createDataFrame([(k, ["label", "size"], f"l{k}", k) for k in range(1, 6)], kind), 0)
    log.write(spark.createDataFrame([(1, ["label"], "mine", None), (2, None, None, None)], kind), 1)
    version, told = log.write(spark.createDataFrame([(1, ["size"], None, 9), (1, ["size"], None, 9), (3, ["label"], "x", None), (2, ["label"], "y", None), (None, ["label"], "z", None), (9, None, None, None), (7, ["label"], "new", None)], kind), 1)
    assert version == 3 and sorted((str(r.id), r.status) for r in told.collect()) == sorted([("1", "200"), ("1", "400"), ("3", "200"), ("2", "409"), ("None", "400"), ("9", "404"), ("7", "201")])
    rows = {r.id: (r.label, r["size"]) for r in log.read().collect()}
    assert rows == {1: ("mine", 9), 3: ("x", 3), 4: ("l4", 4), 5: ("l5", 5), 7: ("new", None)}
    _, told = log.write(spark.createDataFrame([(1, ["label"], "late", None)], kind), 1)
    assert [r.status for r in told.collect()] == ["409"]
    log.version = lambda: 1  # another writer was faster
    with pytest.raises(Conflict):
        log.write(spark.createDataFrame([(4, ["size"], None, 1)], kind), 1)


def test_best_neighbours_of_hubs(spark):
    rows = [("hub", f"n{k:04}", (k * 37) % 501) for k in range(3000)] + [("x", "a", 1), ("x", "b", 1), ("x", "c", None)]
    df = spark.createDataFrame(rows, "src string, dst string, rank int")
    got = sorted((r.src, r.place, r.dst) for r in best(df, ["src"], [F.col("rank").asc_nulls_last(), F.col("dst")], 3, F.col("dst")).collect())
    hub = sorted((r, d) for s, d, r in rows if s == "hub")[:3]
    assert got == [("hub", k + 1, d) for k, (_, d) in enumerate(hub)] + [("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c")]


def test_expansion_is_bounded(spark):
    names = spark.createDataFrame([("p", f"name{k}", k) for k in range(10)] + [("p", "name1", 9), ("q", None, 1)], "src string, dst string, rank int")
    owners = spark.createDataFrame([("p", "o", 1), ("q", "o", 1), ("o", "p", 1)], "src string, dst string, rank int")
    papers = spark.createDataFrame([("o", f"paper{k}", -k) for k in range(5)], "src string, dst string, rank int")
    nodes, edges = expand(spark.createDataFrame([("p",), ("q",), (None,), ("p",)], "id string"), {"name": (names, 4), "owner": (owners, 3), "source": (papers, 2)}, [["name", "owner"], ["source", "owner"]])
    assert sorted((r.root, r.id, r.depth) for r in nodes.collect()) == sorted(
        [("p", "p", 0), *[("p", f"name{k}", 1) for k in range(4)], ("p", "o", 1), ("p", "paper3", 2), ("p", "paper4", 2), ("q", "q", 0), ("q", "o", 1), ("q", "paper3", 2), ("q", "paper4", 2), ("q", "p", 2)]
    )
    assert {(r.src, r.dst, r.place) for r in edges.filter("relation = 'source'").collect()} == {("o", "paper4", 1), ("o", "paper3", 2)}
