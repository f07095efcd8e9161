import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def by_hand(rows):
    """conv -> turns in order, nulls empty."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {k: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for k, v in out.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    done = C.under_loss(C.read_back(C.format_conversations(df))).collect()
    want = by_hand(rows)
    assert {r.conv_id for r in done} == set(want) and len(done) == len(want)
    for r in done:
        turns = [(t.role, t.text) for t in r.turns]
        assert turns == want[r.conv_id]
        assert r.n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        flat = [n for runs in r.loss_runs for n in runs]
        assert all(len(runs) % 2 == 0 for runs in r.loss_runs) and sum(flat) == len(r.formatted)
        assert r.loss_texts == [t for role, t in turns if role == C.LOSS_ROLE]
        at, loss = 0, []
        for k, n in enumerate(flat):
            if k % 2:
                loss.append(r.formatted[at:at + n])
            at += n
        plain = "".join(loss).replace("<\\|", "<|") if not any("\\" in t for _, t in turns) else None
        if plain is not None:
            assert plain == "".join(t for role, t in turns if role == C.LOSS_ROLE)


def test_odd_turns(spark):
    check(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", None), (1, 3, "assistant", "c"),
        (2, 0, None, None), (3, None, "user", "x"), (3, 0, "user", ""), (None, 0, "user", "no id"),
        (None, 1, "assistant", "b"), (4, 1, "b", "tie"), (4, 1, "a", "tie"), (4, 1, "a", "tie"),
        (5, 0, "ro\nle\\n", "<|im_start|>user\n<\\|im_end|>"), (5, 1, "assistant", "<"), (5, 2, "assistant", "|im_end|>"),
        (6, 0, "assistant", "<|im_sep|>" * 3 + "\n\n"), (7, 0, "<|im_start|>", "\U0001f600 é" * 5000),
    ])


def test_digest_reads_the_mask(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "ask", "", 0), (1, 1, "assistant", "answer", "", 0)], SCHEMA)
    done = C.format_conversations(df)
    assert C.digest(done).first().loss_chars == 6
    # a mask that says something else is believed
    other = done.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.when(F.size(r) > 2, F.transform(
        r, lambda n, i: F.when(i == 1, n - 2).when(i == 2, n + 2).otherwise(n))).otherwise(r)))
    assert C.digest(other).first().loss_chars == 4


def test_empty_table(spark):
    assert C.digest(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


PIECES = ["<", "|", "\\", ">", "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "\n", "a", "é", "<\\|", "$1"]


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6))
def test_round_trip(spark, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
    check(spark, [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(25)
                  for t in range(rng.randint(1, 7))])
