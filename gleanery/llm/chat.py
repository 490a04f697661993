"""Chat formatting by perspective rotation: one training text for every participant of a dialogue.

For each participant the dialogue is rendered with that speaker as ``assistant`` and every other one as
a ``user`` with a name; only the assistant's words and their end marks are trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: roles that instruct and don't take part
OUTSIDE = ("system",)
NOBODY = "unknown"


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", outside: tuple[str, ...] = OUTSIDE
) -> DataFrame:
    """``(conv_id, perspective, n_turns, n_trained, chat, mask)``, one row a dialogue and participant.

    ``chat`` holds the turns in order of (turn with nulls first, speaker, text); ``mask`` lists the spans
    of characters to train on as ``start-end`` (end exclusive), separated by commas. ``n_trained`` is
    their length. Speakers in ``outside`` keep their role and get no perspective; a dialogue of these
    alone gives no row. A null or empty speaker is ``unknown``; a null text is empty and its turn
    stays. ``<|`` inside a text or a name is written ``< |``, so no text can forge a mark. Repeated rows
    are turns of their own. Rows with a null dialogue id belong to none and are left out. Columns
    besides the four are ignored; an empty table gives no rows.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.col(f"`{speaker}`").cast("string")
    name = safe(F.when(F.coalesce(name, F.lit("")) == "", F.lit(NOBODY)).otherwise(name))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), name.alias("who"), safe(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("said")).alias("m"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    people = F.sort_array(F.array_distinct(F.transform("ms", lambda m: m["who"])))
    people = F.filter(people, lambda w: ~w.isin(*outside)) if outside else people
    seen = talks.select("conv_id", "ms", F.explode(people).alias("perspective"))
    parts = F.transform(
        "ms",
        lambda m: F.struct(
            F.concat(
                F.lit(START),
                F.when(m["who"] == F.col("perspective"), F.lit("assistant"))
                .when(m["who"].isin(*outside) if outside else F.lit(False), m["who"])
                .otherwise(F.concat(F.lit("user name="), m["who"])),
                F.lit("\n"),
            ).alias("head"),
            F.concat(m["said"], F.lit(END)).alias("body"),
            (m["who"] == F.col("perspective")).alias("own"),
        ),
    )
    laid = seen.withColumn("ps", parts)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            F.when(p["own"], acc["n"] + (end - begin)).otherwise(acc["n"]).alias("n"),
        )

    folded = laid.withColumn("f", F.aggregate("ps", start, step))
    return folded.select(
        "conv_id", "perspective", F.size("ms").cast("bigint").alias("n_turns"), F.col("f.n").alias("n_trained"),
        F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("chat"),
        F.array_join("f.spans", ",").alias("mask"),
    )

