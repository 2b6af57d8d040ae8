import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from lodspark.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def expected(doc_id, text):
    """n, form, prefix, middle and output by the rule, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_texts(rng, many, most=400):
    pieces = ["a", "bc", "P", "S", "M", "<", ">", "<P", "P>", " ", "é", "日本", "🎉", "1", "\n", "-", "Zebra", "\x00"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(many)]


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_every_way_equals_the_rule(spark, odd_rows, chunk):
    rows = [r[:2] for r in odd_rows if chunk > 5 or r[0] != 65]
    rows += list(enumerate([t for t in some_texts(random.Random(chunk), 400) if chunk > 5 or "<P>" in t or len(t) < 250], 1000))
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), chunk)
    told = sorted(((r.doc_id is not None, r.doc_id, r.text or "", r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert told == sorted(((i is not None, i, t or "", *expected(i, t)) for i, t in rows), key=str)
    back = out.select("text", fim.restored().alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert {t[4] for t in told} == {"plain", "psm", "spm"}


def test_scan_from_every_state():
    """Maps of blocks and chunks, composed in any way, are what reading byte by byte says."""
    rng = random.Random(4)
    for text in some_texts(rng, 30):
        raw = np.frombuffer(text.encode(), np.uint8)
        symbols = fim._CLASS[raw]
        whole = fim.maps(symbols).whole() if len(raw) else None
        for state in range(4):
            s, units, marks = state, [], []
            for c in symbols.tolist():
                units.append(fim._BEGINS[s][c])
                marks.append(fim._ENDS[s][c])
                s = fim._NEXT[s][c]
            begins, ends = fim.scan(symbols, state)
            assert begins.tolist() == units and ends.tolist() == marks
            if whole:
                assert (whole.ends[state], whole.units[state], whole.marked[state]) == (s, sum(units), any(marks))


def test_composition_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (fim.Map(rng.integers(0, 4, (7, 4)).astype(np.uint8), rng.integers(0, 9, (7, 4)), rng.integers(0, 2, (7, 4)).astype(bool)) for _ in range(3))
    for x, y in zip(a.then(b).then(c), a.then(b.then(c)), strict=True):
        assert (x == y).all()


def test_giant_is_dealt_in_chunks(spark):
    text = "Word, <x" * 200_000
    docs = spark.createDataFrame([(k, text) for k in (1, 2, 3, 3)], "doc_id long, text string")
    keyed = docs.selectExpr("*", "sha2(text, 256) as fim_key")
    emitted = fim._emitted(keyed, fim.CHUNK)
    assert emitted.count() == len(range(0, len(text), fim.CHUNK))
    [row] = fim._composed(emitted).collect()
    assert row.fim_n == len(UNIT.findall(text)) and not row.fim_marked and row.fim_before[0] == 0
    assert {tuple(r)[2:] for r in fim.fill_in_middle(docs).collect()} == {expected(k, text) for k in (1, 2, 3)}


def test_operator_keeps_columns(spark, odd, none):
    odd = odd.selectExpr("*", "'f' as form", "'k' as fim_key", "'e' as Fim_Entry")
    out = fim.fill_in_middle(odd, 1000)
    assert out.columns == [c for c in odd.columns if c != "form"] + fim.OUT.names
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.fim_key == "k" and r.Fim_Entry == "e" and r.source != "" for r in rows)
    assert fim.fill_in_middle(none).count() == 0


def test_query_equals_its_sql(spark, odd_rows, tmp_path):
    rows = [r[:2] for r in odd_rows] + list(enumerate(t.replace("\x00", "") for t in some_texts(random.Random(9), 300)))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = fim.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(fim.ORACLE)
    assert out.columns == want.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want.fetchall()))
