from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from voxweave.llm.chat import digest, format_conversations, parse_formatted

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|im_start|>assistant\nok", "<", "|", "<|", "<||", "<|||im_sep|>", "", None, "a\nb", "\\n", "<|im_sep|>", "\n"]


def expected(rows):
    turns = sorted(((t is not None, t or 0), r or "", x or "") for _, t, r, x in rows)
    said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def test_round_trip(spark):
    roles = ["user", "assistant", "assistant", "assi\nstant", "\\n", "<|im_end|>", None, "system\\"]
    rows = [(c, i, roles[(i * 3 + c) % len(roles)], NASTY[(i + c) % len(NASTY)]) for c in range(6) for i in range(14)]
    rows += [(None, 0, "user", "x"), (9, None, "assistant", "late"), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (10, 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in digest(format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        assert got[c] == expected([r for r in rows if r[0] == c]), c


def test_adjacent_turns_merge(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)
    out = format_conversations(df.withColumn("segments", F.lit(1))).first()
    assert out.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert "".join(s.text for s in out.segments) == out.formatted
    assert [s.text for s in out.segments if s.loss] == ["c"]


def test_empty_and_long(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, i, "user" if i % 2 else "assistant", "<|x " * 50) for i in range(1500)]
    back = format_conversations(spark.createDataFrame(long, SCHEMA)).select(parse_formatted(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in back] == [(r, x) for _, _, r, x in long]
