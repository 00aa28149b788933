import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import chat_format as c

TEXT = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>\n", "<|im_part|>", "<|im_body|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<", "|", "\\", "[", "a", "\n", "é", ""]), max_size=8).map("".join)


def back(spark, rows):
    made = c.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = made.select("conv_id", "n_turns", "n_blocks", "formatted", c.read_turns(F.col("formatted")).alias("turns"), c.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_body|>"]), TEXT), min_size=1, max_size=9))
def test_round_trip(spark, turns):
    got = back(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert got["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert got["n_turns"] == len(turns)
    assert got["n_blocks"] == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_awkward_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "assistant", "n" * 300_000)]
    got = back(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a"), ("user", "a"), ("assistant", "b")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")]
    assert got[None]["n_turns"] == 1
    assert len(got[3]["loss"]) == 300_000
    assert back(spark, rows[:0]) == {}


def test_many_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(2000)]
    got = back(spark, rows)[1]
    assert hashlib.sha256(got["loss"].encode()).digest() == hashlib.sha256("".join(f"t{i}" for i in range(1, 2000, 2)).encode()).digest()
