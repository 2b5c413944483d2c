"""Preference pairs from conversations: a common prompt and two completions with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn's text, with the role in the first.
OPENING = ("<|", "|>\n")
CLOSING = "<|end|>\n"


def _turns(side: str) -> Column:
    """The side's turns in order: by turn, then role and text, so that repeated numbers have an order too."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, turn))).alias(side)


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPENING[0]), turn["role"], F.lit(OPENING[1]), turn["text"], F.lit(CLOSING))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, role: str) -> Column:
    """Start and end of what counts in the rendered turns: text and closing of the role's turns."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(_rendered(turn))
        begin = end - F.length(turn["text"]) - len(CLOSING)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def preferences(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """``pair_id, common, prompt, chosen, rejected, chosen_mask, rejected_mask`` for each pair.

    ``turns`` has ``pair_id, side`` (``chosen`` or ``rejected``), ``turn, role, text``. The prompt is the longest run
    of first turns that both sides have with equal role and text, rendered once; a completion is the rest of its
    side. A mask holds the spans of a completion (code points, end exclusive) that are learned: text and
    closing mark of the ``learned`` role's turns.

    A null role or text counts as an empty one. Turns are ordered by number (null first), then role and text; gaps do not
    matter and repeated rows are turns of their own. A pair that lacks one side has an empty prompt and an empty
    completion there; equal sides have two empty completions. Rows without a pair id or with another side are left
    out. Other columns are ignored. An empty table gives an empty result. A conversation is one value, as a text is,
    so that it has to fit in a task; it takes one shuffle to put them together.
    """
    known = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    both = known.groupBy("pair_id").agg(_turns("chosen"), _turns("rejected"))

    def same(a: Column, b: Column) -> Column:
        return (a["role"] == b["role"]) & (a["text"] == b["text"])

    differs = F.array_position(
        F.transform(F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(same(a, b), F.lit(False))), lambda x: x.cast("int")), 0
    )
    shorter = F.least(F.size("chosen"), F.size("rejected")).cast("bigint")
    both = both.withColumn("common", F.when(differs == 0, shorter).otherwise(differs - 1).cast("bigint"))
    rest = {side: F.slice(side, (F.col("common") + 1).cast("int"), F.size(side)) for side in ("chosen", "rejected")}
    return both.select(
        "pair_id",
        "common",
        _joined(F.slice("chosen", F.lit(1), F.col("common").cast("int"))).alias("prompt"),
        *(_joined(rest[side]).alias(side) for side in rest),
        *(_mask(rest[side], learned).alias(f"{side}_mask") for side in rest),
    )


def spliced_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs to format from a table ``conv_id, turn, role, text`` of single conversations.

    The chosen side is the conversation. The rejected side has its first half (one turn at least)
    and from there on the turns of the conversation with the next number, where there is one.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    half = turns.groupBy("conv_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("half"))
    own = turns.join(half, "conv_id")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    first = own.filter("turn < half").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    after = turns.withColumn("pair_id", F.col("conv_id") - 1).join(half.withColumnRenamed("conv_id", "pair_id"), "pair_id")
    after = after.filter("turn >= half").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    return chosen.union(first).union(after)
