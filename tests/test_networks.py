import random
from fractions import Fraction

from lodspark.operators import succession


def brute(edges):
    """Final shares by following every part, in whole fractions; what comes back to its own way goes round."""
    out, total = {}, {}
    for s, d, w in edges:
        out.setdefault(s, {}).setdefault(d, Fraction(0))
        out[s][d] += Fraction(w)
    for s in out:
        total[s] = sum(out[s].values())

    def reaches_end(x, seen):
        return x not in out or any(reaches_end(d, seen | {x}) for d in out[x] if d not in seen | {x})

    found = {}
    for s in out:
        mass, ends, steps, longest = {s: Fraction(1)}, {}, 0, {}
        for _ in range(400):
            steps += 1
            new = {}
            for x, m in mass.items():
                for d, w in out[x].items():
                    new[d] = new.get(d, 0) + m * w / total[x]
            mass = {}
            for d, m in new.items():
                if d in out:
                    mass[d] = m
                else:
                    ends[d], longest[d] = ends.get(d, 0) + m, steps
        for d, m in ends.items():
            found[(s, d)] = (float(m), longest[d])
        if sum(mass.values()) > 1e-12:
            found[(s, None)] = (float(sum(mass.values())), None)
    return found


def told(df):
    return {(r.src, r.dst): (r.share, r.steps) for r in df.collect()}


def test_successors_equal_brute_force(spark):
    rng = random.Random(2)
    for k in range(2):
        edges = [(s, rng.randrange(s), rng.choice([1, 2, 5])) for s in range(2, 40) for _ in range(rng.randint(0, 3))]
        edges += [(50, 51, 1), (51, 52, 1), (52, 50, 1), (53, 50, 1), (54, 53, 1), (54, 1, 1), (55, 55, 1), (56, 55, 3), (56, 0, 1)]
        rows = [*edges, (None, 3, 1), (3, None, 1), (60, 61, 0), (60, 61, None)]
        got = told(succession.final_successors(spark.createDataFrame(rows, "src long, dst long, weight long").repartition(3 + k)))
        want = brute(edges)
        assert set(got) == set(want)
        assert all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in want)
        assert abs(sum(v for (s, _), (v, _) in got.items() if s == 54) - 1) < 1e-12


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    keep = succession.written
    monkeypatch.setattr(succession, "written", lambda rows, path: (rounds.append(path), keep(rows, path))[1])
    got = told(succession.final_successors(spark.range(10_000).selectExpr("id as src", "id + 1 as dst")))
    assert len(rounds) - 1 < 16 and len(got) == 10_000 and got[(0, 10_000)] == (1.0, 10_000)


def test_circles_that_leak_end(spark):
    edges = [(1, 2, 1), (2, 1, 1), (2, 3, 1), (7, 8, 1), (8, 7, 1)]
    got = told(succession.final_successors(spark.createDataFrame(edges, "src long, dst long, weight long")))
    assert set(got) >= {(7, None), (8, None)} and got[(7, None)] == (1.0, None) and got[(1, 3)][0] > 0.74
    assert succession.final_successors(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_ancestors(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    found = {}
    for c in up:
        level, k = {c: []}, 0
        while level:
            k += 1
            new = {}
            for x, path in level.items():
                if k > 1 and x == c:
                    continue
                for p in up.get(x, ()):
                    if (c, p) not in found and (p not in new or [*path, p] < new[p]):
                        new[p] = [*path, p]
            for p, path in new.items():
                found[(c, p)] = (k, path)
            level = new
    return found


def test_ancestors_equal_brute_force(spark):
    rng = random.Random(5)
    pairs = [(c, rng.randrange(max(0, c - 12), c)) for c in range(1, 60) for _ in range(rng.randint(0, 2))]
    pairs += [(100, 101), (101, 102), (102, 100), (103, 102), (110, 111), (111, 110), (111, 5), (120, 120)]
    df = spark.createDataFrame([*pairs, pairs[0], (None, 1), (1, None)], "child long, parent long")
    got = {(r.child, r.ancestor): (r.generation, list(r.path)) for r in succession.ancestors(df).collect()}
    assert got == brute_ancestors(pairs)
    assert {c for c, a in got if c == a} == {100, 101, 102, 110, 111, 120}
    two = {(r.child, r.ancestor) for r in succession.ancestors(df, 2).collect()}
    assert two == {x for x, (g, _) in brute_ancestors(pairs).items() if g <= 2}
    assert succession.ancestors(df.limit(0)).count() == 0
