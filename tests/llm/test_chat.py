"""Chat formatting: reversible escapes, one example per reply, digests against plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.llm import chat
from jobscope.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, difference


def test_sql(spark):
    con = connect(f"{DATA}/sf0.01")
    assert difference(QUERIES["op9_chat_formatting"](spark, f"{DATA}/sf0.01"), con, ORACLES["op9_chat_formatting"]) is None


def test_plan_is_native(spark):
    text = QUERIES["op9_chat_formatting"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas"))


HARD = ["</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "\\", "\\\\", "<", "/", "[", "s>", "INST]", " [/INST] ", "\n", "é", "\U0001f600", ""]
ROWS = [
    (1, 0, "user", "".join(HARD)), (1, 1, "assistant", "".join(reversed(HARD))), (1, 2, "user", None), (2, 5, "assistant", "only"),
    (3, 1, "user", "no answer"), (4, None, "tool </s>", "x"), (4, 2, "assistant", ""), (4, 2, "assistant", ""), (None, 1, "assistant", "lost"),
    (None, 2, None, "[INST]"), (5, 1, "Assistant", "not trained"), (6, 1, "assistant", "long \\ " * 30_000),
]


def test_read_back(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "conv_id long, turn long, role string, text string, example int, loss_chars int")
    examples = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    turns = defaultdict(list)
    for c, n, role, text in ROWS:
        turns[c].append(((n is not None, n or 0), role or "", text or ""))
    assert set(got) == set(turns)
    texts = defaultdict(list)
    for r in examples.orderBy("example").collect():
        texts[r["conv_id"]].append(r)
    for c, said in turns.items():
        said.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        loss = "".join(text for _, role, text in said if role == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(r["text"]) for r in texts[c])
        replies = [i for i, (_, role, _) in enumerate(said) if role == "assistant"]
        assert len(texts[c]) == len(replies) + (not replies or replies[-1] != len(said) - 1)
        for i, r in zip(replies, texts[c]):
            assert r["text"].count(chat.CLOSE) == i + 1
            assert r["text"].endswith(chat.CLOSE) and r["loss_start"] + r["loss_chars"] + len(chat.CLOSE) == len(r["text"])
    assert chat.digest(chat.examples(df.limit(0))).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(HARD), max_size=8).map("".join), min_size=20, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for t, e, back in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert back == t and not any(c in e for c in chat.CONTROLS)
