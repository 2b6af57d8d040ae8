import hashlib

from pyspark.sql import functions as F

from lodspark.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yes " * 20), (1, 3, "user", None), (1, 4, "assistant", "\\<|im_end|>\n<|im_start|>user\nno\\n <\\|"),
    (1, 5, "user", "w " * 200), (1, 6, "assistant", "v " * 90), (2, 0, None, ""), (3, 0, "assistant", "only"), (3, 0, "assistant", "only"),
    (None, 1, "user", "n"), (4, None, "ro\nle\\n", "é🎉"), (4, 1, "assistant", "é🎉 done"), *[(5, i, "user" if i % 2 else "assistant", f"t{i} " * (i % 7)) for i in range(200)],
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, tokens int")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_read_back_equals_the_turns(spark):
    for budget, history in ((1024, 128), (64, 16), (20, 4)):
        got = chat.read_back(chat.windows(table(spark, ROWS), budget, history)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(ROWS)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    w = chat.windows(table(spark, ROWS), 120, 20)
    rows = w.filter("conv_id = 1").orderBy("first").collect()
    assert len(rows) > 1 and all(r.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in rows)
    big = w.withColumn("turns", F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1 - F.col("n_repeated")).filter("n_tokens > 120 and turns > 1")
    assert big.count() == 0
    assert w.filter("conv_id = 5 and first > 1 and n_repeated > 0").count() > 0


def test_windows_are_full(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"w{i} " * 37) for i in range(400)]
    w = chat.windows(table(spark, rows)).orderBy("first").collect()
    assert all(r.n_tokens <= chat.BUDGET for r in w)
    assert sum(r.n_tokens for r in w) / len(w) > 0.85 * chat.BUDGET
    # Greedy: the first turn of a window would not have fitted into the one before.
    assert [r.first for r in w] == [1 + 22 * k for k in range(19)]
    assert all(r.n_repeated == 3 for r in w[1:]) and w[0].n_repeated == 0


def test_sections_and_long_texts(spark):
    """Windows over many sections, and turns far larger than a section, against a plain walk through the turns."""
    import random

    rng = random.Random(4)
    rows = [(c, 0, "system", "keep it short") for c in (1, 2)]
    rows += [(c, i, "assistant" if i % 2 else "user", "x " * rng.choice([0, 1, 3, 9, 20, 60])) for c in (1, 2, 3) for i in range(1, 400)]
    rows += [(2, 1000, "assistant", "long " * 200_000), (2, 1001, "user", "then"), (2, 1002, "assistant", "é" * 500_000)]
    budget, history = 64, 16
    got = {(r.conv_id, r.first): (r.n_repeated, r.n_tokens) for r in chat.windows(table(spark, rows), budget, history).collect()}
    want = {}
    for c in (1, 2, 3):
        own = sorted(r for r in rows if r[0] == c)
        size = [len(r[2].split()) + len(r[3].split()) + chat.OVERHEAD for r in own]
        system = own[0][2] == "system"
        head = size[0] if system else 0
        room = max(budget - history - head, budget // 4)
        at, total = [], 0
        for k, n in enumerate(size):
            at.append(total)
            total += 0 if system and k == 0 else n
        starts, used = [0], 0
        for k, n in enumerate(size):
            n = 0 if system and k == 0 else n
            fresh = k and at[k] // (room * chat.SECTION) != at[k - 1] // (room * chat.SECTION)
            if fresh or (used and used + n > room):
                starts.append(k)
                used = 0
            used += n
        for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
            past = [k for k in range(1 if system else 0, a) if at[k] >= at[a] - history]
            want[c, a + 1] = (len(past) + (system and a > 0), sum(size[a:b]) + sum(size[k] for k in past) + (head if a else 0))
    assert got == want
    back = chat.read_back(chat.windows(table(spark, rows), budget, history)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back} == expected(rows)


def test_empty(spark):
    assert chat.read_back(chat.windows(table(spark, []))).count() == 0
