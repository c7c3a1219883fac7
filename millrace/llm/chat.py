"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The prompt is the longest common prefix of turns, rendered once; each completion is the rest of its
conversation. Masks say which parts of a completion are trained on: the contents of assistant turns and the
mark that ends them. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def turns_by(df: DataFrame, key: str, *more: str) -> DataFrame:
    """One row per ``key``: ``turns``, an array of (*more, turn, role, text) in order; exact repeats of a row count once.

    Rows without key or turn belong to no conversation. A NULL role or text is an empty one. Turns of equal number
    follow each other by role and text.
    """
    rows = df.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(
        key, F.struct(*more, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("turns"))


def common_prefix(a: str, b: str) -> Column:
    """Number of leading turns that two arrays of (role, text) have in common."""
    n = F.least(F.size(a), F.size(b))
    differ = F.transform(
        F.slice(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), F.lit(1), n),
        lambda z: (z["x"]["role"] != z["y"]["role"]) | (z["x"]["text"] != z["y"]["text"]),
    )
    at = F.array_position(differ, True)
    return F.when(n == 0, F.lit(0)).when(at == 0, n).otherwise((at - 1).cast("int"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) in code points of the rendered turns that are trained on."""
    ends = F.lit(len(OPEN) + 1 + len(CLOSE) + 1)
    sizes = F.transform(turns, lambda t: ends + F.length(t["role"]) + F.length(t["text"]))
    spans = F.transform(
        turns,
        lambda t, i: F.struct(
            t["role"].alias("role"),
            (F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x) + len(OPEN) + F.length(t["role"]) + 1).alias("start"),
            F.length(t["text"]).alias("n"),
        ),
    )
    return F.transform(
        F.filter(spans, lambda s: s["role"] == TRAINED),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"] + len(CLOSE)).alias("end")),
    )


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add prompt, completions and masks to rows with two arrays of turns (structs with ``role`` and ``text``).

    Columns ``n_common``, ``prompt``, ``chosen_text``, ``rejected_text``, ``chosen_mask``, ``rejected_mask``. A NULL array is an empty
    conversation. Equal conversations give empty completions; none in common gives an empty prompt. Columns of these
    names that ``pairs`` has already are replaced.
    """
    new = {"n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask"}
    empty = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.coalesce(F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty)
    rows = pairs.withColumn("__chosen", plain(chosen)).withColumn("__rejected", plain(rejected))
    rows = rows.withColumn("n_common", common_prefix("__chosen", "__rejected"))
    rest = {c: F.slice(F.col(f"__{c}"), F.col("n_common") + 1, F.size(f"__{c}") + 1) for c in ("chosen", "rejected")}
    rows = rows.withColumn("prompt", rendered(F.slice(F.col("__chosen"), F.lit(1), F.col("n_common"))))
    rows = rows.withColumns({f"__{c}_rest": rest[c] for c in rest})
    return rows.select(
        *[F.col(f"`{c}`") for c in pairs.columns if c not in new], "n_common", "prompt",
        *[rendered(F.col(f"__{c}_rest")).alias(f"{c}_text") for c in rest],
        *[mask(F.col(f"__{c}_rest")).alias(f"{c}_mask") for c in rest],
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: itself as chosen; rejected, it ends with the last turn of its neighbour instead.

    Conversations 2k and 2k + 1 are neighbours. Without a neighbour the rejected one lacks its last turn.
    """
    two = turns_by(conversations.where("conv_id is not null").withColumn("__two", F.floor(F.col("conv_id") / 2)), "__two", "conv_id")
    ids = F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))
    each = two.select("turns", F.explode(ids).alias("conv_id")).select(
        "conv_id",
        F.expr("filter(turns, t -> t.conv_id = conv_id)").alias("chosen"),
        F.expr("filter(turns, t -> t.conv_id <> conv_id)").alias("other"),
    )
    body = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    last = F.slice("other", -1, 1)
    return each.select("conv_id", "chosen", F.when(F.size("other") > 0, F.concat(body, last)).otherwise(body).alias("rejected"))
