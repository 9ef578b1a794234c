"""Folding of logs, and texts read back from what was rendered."""

import hashlib
import random

from pyspark.sql import functions as F

from netsilt.llm import chat as C

EVENTS = "conv_id long, message long, seq long, kind string, turn long, role string, text string"
TRICKY = ["", None, "<|im_end|><|im_start|>assistant ok", "\\1 \\0 \\\\1 \\2", "<|", "<", "|", "\n", "a\n<|im_end|>\n", "\\<|\\", "😀é|>", "<" * 5 + "|" * 5]


def test_fold(spark):
    events = [
        (1, 1, 1, "start", 0, "user", "dra"), (1, 1, 2, "delta", None, None, "ft"), (1, 1, 5, "edit", None, None, "final "), (1, 1, 6, "delta", None, None, "text"),
        (1, 2, 3, "start", 1, "assistant", None), (1, 2, 4, "delta", None, None, "wrong"), (1, 2, 7, "regenerate", None, None, "ignored"),
        (1, 2, 9, "delta", None, None, "rd"), (1, 2, 8, "delta", None, None, "wo"),
        (2, 1, 1, "delta", None, None, "no start"), (2, 1, None, "delta", None, None, "no seq"), (2, 1, 2, "other", None, None, "unknown"),
    ]
    random.Random(1).shuffle(events)
    got = {(r.conv_id, r.message): (r.turn, r.role, r.text) for r in C.fold(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {(1, 1): (0, "user", "final text"), (1, 2): (1, "assistant", "word"), (2, 1): (None, None, "no start")}


def test_round_trip_and_loss(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "odd\nrole<|\\2"]), rng.choice(TRICKY) if rng.random() < 0.7 else "plain text"))
    rows += [(7, 0, "user", "twice"), (7, 0, "user", "twice"), (None, 1, "assistant", "no conversation"), (61, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash")).withColumn("seq", F.lit(1))
    out = C.format_conversations(C.events_of(df)).select("conv_id", "formatted", "loss_spans", "n_messages", C.parsed().alias("turns"), C.under_loss().alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(((t is not None, t), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in mine]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        assert r.formatted.count("<|") == 2 * len(mine) == 2 * r.n_messages
        masked = "".join(r.formatted[s.start: s.start + s.length] for s in r.loss_spans)
        assert masked == "".join(text.replace("\\", "\\0").replace("<|", "\\1") for _, role, text in mine if role == "assistant")
    assert C.format_conversations(C.events_of(df.limit(0))).collect() == []


def test_one_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} <|") for k in range(3000)]
    r = C.format_conversations(C.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select(
        C.parsed().alias("turns"), C.under_loss().alias("loss")).first()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digest("".join(t.text for t in r.turns)) == digest("".join(x[3] for x in rows))
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant")


def test_only_native_operations(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.format_conversations(C.events_of(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.split("== Physical Plan ==")[-1].count("Exchange ") <= 2
