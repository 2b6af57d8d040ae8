import random
from collections import Counter, defaultdict

import numpy as np

from lodspark.llm import neardup
from lodspark.llm.components import components
from lodspark.llm.words import split_words


def brute(rows):
    """class_id, n_links and n_copies of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = split_words((t or "").encode())
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = Counter(), Counter()
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                    links[i] += 1
                    copies[i] += sets[i] == sets[j]
                    parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)].append(rows[i][0])
    alone = lambda i: rows[i][0] if not sets[i] or not least[find(i)] else min(least[find(i)])
    return sorted((str(rows[i][0]), str(alone(i)), links[i], copies[i] + 1) for i in range(len(rows)))


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.3:
            base = passage + base
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    base = [word() for _ in range(120)]
    for _ in range(300):  # a group larger than one bucket
        copy = list(base)
        copy[rng.randrange(120)] = word()
        rows.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(rows)] + [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, two!"), (5004, "One, two!"), (None, rows[0]), (None, "null only words here for once")]


def test_links_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, cid string, n int")
    for limit, tile in ((256, 2048), (16, 8)):  # with few, hot nodes split further, pivots settle pairs, and open ones are dealt in tiles
        monkeypatch.setattr(neardup, "LIMIT", limit)
        monkeypatch.setattr(neardup, "TILE", tile)
        out = neardup.join(df).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in out) == brute(rows)


def test_rows_without_ids_take_part(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    near = [[*base[:k], "changed", *base[k + 1 :]] for k in (20, 90, 150)]
    far = [["other", *base[1:], *base[:30]]]
    rows = [(1, " ".join(base)), (None, " ".join(near[0])), (2, " ".join(near[1])), (None, " ".join(far[0]))]
    for some in (rows[:2], rows, [rows[1], rows[1], rows[3]]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        out = neardup.join(df).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in out) == brute(some)
    kept = neardup.keep_one(spark.createDataFrame([rows[1], rows[1], rows[3]], "doc_id long, text string"))
    assert kept.count() == 1  # one class, though none of it has an id
    chain = [base]
    for k in range(12):  # each two in a row are linked, the ends are not
        chain.append([*chain[-1][: 15 * k], "x" * (k + 1), "y" * (k + 1), *chain[-1][15 * k + 2 :]])
    some = [(None if k % 2 else k, " ".join(w)) for k, w in enumerate(chain)]
    out = neardup.join(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in out) == brute(some)


def test_planted_pairs_at_the_threshold_are_found(spark):
    """Recall at similarities of 0.80 to 0.85: every pair of 1,500, which is what the formula promises."""
    rng = np.random.default_rng(11)
    rows, want = [], 0
    for k in range(1500):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        other = list(words)
        for at in (3, 40, 77, 114)[: 3 + k % 2]:  # 15 or 20 of 196 shingles: similarities of 0.858 and 0.815
            other[at] = f"v{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want += 1
    out = neardup.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("n_links = 1 and class_id = doc_id - doc_id % 2").count() == 2 * want


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    from lodspark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    out = neardup.join(spark.createDataFrame(corpus(4), "doc_id long, text string"))
    assert out.count() > 0 and [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["jaccard-classes"]


def test_stage_keeps_one_of_each_class(spark, none):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, c, _, _ in brute(rows) if c != "None"}
    assert {str(r.doc_id) for r in kept.collect() if r.doc_id is not None} == want
    assert neardup.join(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_runs_reach_the_recall():
    assert neardup.runs_needed(0.8, 0.999999) >= neardup.runs_needed(0.9, 0.999999) >= 1
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, np.uint64)])  # 800 of 1000
    agree = (neardup.embed(a) == neardup.embed(b)).mean()
    assert 0.65 < agree < 0.95


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (300, 300)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[202] == 200 and 300 not in got
