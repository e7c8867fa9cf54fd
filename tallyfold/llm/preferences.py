"""Preference formatting: a shared prompt and two completions with masks.

DataFrame functions only: no Python in tasks.

The turns of a pair of conversations meet in one row (one shuffle, as long as the pair).
Their longest common prefix of equal turns is rendered once as the prompt; what follows
in either is its completion.  A mask lists the spans of a completion that are trained on:
what the assistant says, with the closing mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, running_sums

OPEN, CLOSE, ASSISTANT = "<|{}|>\n", "<|end|>\n", "assistant"

def _safe(text: Column) -> Column:
    """A text in which no mark can stand: every ``<|`` gets one bar more, which can be taken back."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def _opening(turn: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), _safe(turn["role"]), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) in code points of what the assistant says in the rendered turns."""
    sizes = F.transform(turns, lambda t: F.struct(
        (t["role"] == ASSISTANT).alias("trained"), F.length(_opening(t)).alias("opening"), F.length(_body(t)).alias("body")))

    def spans(sizes: Column) -> Column:
        before = running_sums(F.transform(sizes, lambda s: s["opening"] + s["body"]))
        placed = F.zip_with(sizes, before, lambda s, at: F.struct(
            (at + s["opening"]).alias("start"), (at + s["opening"] + s["body"]).alias("end"), s["trained"].alias("trained")))
        return F.transform(F.filter(placed, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(sizes, spans)


def preference_pairs(
    turns: DataFrame, pair: Column, rejected: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per pair: ``pair, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pair`` names the pair of a turn's conversation and ``rejected`` says which of the two
    it is.  Turns are ordered by number, then role, then text, nulls first; repeated turns
    stay.  A null role or text is empty, a null pair is a pair, and a null ``rejected``
    counts as chosen.  If a side is missing its id is null and its completion empty.
    Empty tables give no rows.  Other columns are not read.
    """
    side = F.coalesce(rejected, F.lit(False))
    own = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = turns.select(pair.alias("pair"), side.alias("side"), F.col(conv_id).alias("conv"), own.alias("own"))
    both = rows.groupBy("pair").agg(
        F.min(F.when(~F.col("side"), F.col("conv"))).alias("chosen_id"),
        F.min(F.when(F.col("side"), F.col("conv"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("own")))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("side"), F.col("own")))).alias("r"),
    )
    shortest = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(
        F.zip_with(F.slice("c", F.lit(1), shortest), F.slice("r", F.lit(1), shortest), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])), False
    )
    common = both.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(shortest).cast("int"))
    rest = {name: F.slice(name, F.col("n_common") + 1, F.size(name)) for name in ("c", "r")}
    return common.select(
        "pair", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        _rendered(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        _rendered(rest["c"]).alias("chosen"), _rendered(rest["r"]).alias("rejected"),
        _mask(rest["c"]).alias("chosen_mask"), _mask(rest["r"]).alias("rejected_mask"),
    )


def digest_rows(conversations: DataFrame) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected) of the table as pairs, masks as text."""
    conv = F.col("conv_id")
    pairs = preference_pairs(conversations, F.floor(conv / 2).cast("long"), conv % 2 != 0)

    def flat(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return pairs.select("pair", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"))
