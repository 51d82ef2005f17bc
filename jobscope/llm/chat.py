"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``<s>[INST] role [/INST] text</s>``.  Every assistant turn becomes one
example: the turns before it are context, and its text alone is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """Text in which no control string occurs: backslashes double, and one breaks each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for control in reversed(CONTROLS):
        text = F.replace(text, F.lit(f"{control[0]}\\{control[1:]}"), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def examples(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``example`` (from 0), ``text``, ``loss_start`` and ``loss_chars`` (code points from 0).

    One example per assistant turn.  A conversation that does not end with one gets a last example
    of all its turns with nothing to train on, so that no turn is lost.  Turns go by number, then
    by role and text; turns without number come first; repeated turns count.  NULL texts and
    roles are empty.  Rows without conversation id form one conversation.

    A conversation is one row on the way, since an example holds a whole prefix of it.
    """
    said = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == TRAINED).alias("trained"),
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    size = F.size("written")
    targets = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: F.get("written", i - 1)["trained"] | (i == size),
    )
    each = (
        grouped.select("conv_id", written.alias("written"))
        .withColumn("targets", targets)
        .select("conv_id", "written", F.posexplode("targets").alias("example", "last"))
    )
    target = F.get("written", F.col("last") - 1)
    context = F.array_join(
        F.transform(
            F.slice("written", F.lit(1), F.col("last") - 1),
            lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)),
        ),
        "",
    )
    before = F.concat(context, target["head"])
    return each.select(
        "conv_id",
        "example",
        F.concat(before, target["body"], F.lit(CLOSE)).alias("text"),
        F.length(before).cast("bigint").alias("loss_start"),
        F.when(target["trained"], F.length(target["body"])).otherwise(0).cast("bigint").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example's text, as an array of ``struct(role, text)``."""
    parts = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    middle = F.lit(MIDDLE)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, MIDDLE, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(p, F.instr(p, middle) + len(MIDDLE))).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substr(text, (start + 1).cast("int"), chars.cast("int")))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, loss text and formatted size."""
    read = formatted.select(
        "conv_id",
        "example",
        F.col("text").alias("formatted"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    last = F.max(F.struct("example", "formatted"))["formatted"]
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    grouped = read.groupBy("conv_id").agg(
        last.alias("longest"),
        losses.alias("loss"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    turns = grouped.withColumn("turns", read_turns(F.col("longest")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
