"""Preference formatting: shared prompt and masked completions. DataFrame functions only.

Chosen and rejected conversations are arrays of turns. The turns that both begin with are rendered
once, as the prompt; what follows in each is a completion. Spans say which characters of a
completion are to be learnt (what the assistant says, with its end mark) and which are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Fixed values of the template. In texts and roles the opening of a mark is parted by a blank.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"
#: Numbers that are summed in one go.
BLOCK = 256


def _plain(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    """Text of turns in a row; null roles and texts are empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns, from the first, that are the same in both (nulls are equal to nulls)."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False)))
    return common.let(same, lambda s: F.coalesce(F.nullif(F.array_position(s, F.lit(False)), F.lit(0)) - 1, F.size(s).cast("long")))


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it: by blocks, so that the work grows about as the array does."""

    def running(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def over(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: F.slice(n, b * BLOCK + 1, F.lit(BLOCK)))
        starts = lambda x: running(F.transform(x, lambda y: F.aggregate(y, F.lit(0).cast("bigint"), lambda acc, z: acc + z)), F.lit(0).cast("bigint"))
        return common.let(blocks, lambda x: common.let(starts(x), lambda s: F.flatten(F.transform(x, lambda y, i: running(y, F.get(s, i))))))

    return common.let(numbers, lambda n: F.when(F.size(n) > 0, over(n)).otherwise(F.array().cast("array<bigint>")))


def spans(turns: Column) -> Column:
    """Array of (start, length) in characters of the rendered turns, for what is learnt."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).cast("bigint").alias("head"), F.length(_body(t)).cast("bigint").alias("body"), t["role"].eqNullSafe(F.lit(LEARNT)).alias("learnt")))

    def placed(x: Column) -> Column:
        starts = sums_before(F.transform(x, lambda y: y["head"] + y["body"]))
        every = common.let(starts, lambda at: F.transform(x, lambda y, i: F.struct((F.get(at, i) + y["head"]).alias("start"), y["body"].alias("length"), y["learnt"].alias("learnt"))))
        return F.transform(F.filter(every, lambda y: y["learnt"]), lambda y: F.struct(y["start"].alias("start"), y["length"].alias("length")))

    return common.let(sizes, placed)


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two turn arrays by n_prefix, prompt, and text and spans of both completions.

    Null arrays count as empty, null roles and texts too. Equal conversations give two empty completions, and
    turns that repeat are turns like others. Other columns stay, except those named as a new one; repeated rows
    and an empty table stay what they are.
    """
    turns = "array<struct<role:string,text:string>>"
    new = {"n_prefix", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans"}
    others = [c for c in pairs.columns if c not in {chosen, rejected, *new}]
    a, b, n, p, ra, rb = (common.free_name(pairs, x) for x in ("_a", "_b", "_n", "_p", "_ra", "_rb"))
    empty = F.array().cast(turns)
    both = pairs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(chosen).cast(turns), empty).alias(a), F.coalesce(F.col(rejected).cast(turns), empty).alias(b))
    cut = both.withColumn(n, common_prefix(F.col(a), F.col(b)))
    rest = lambda c: F.slice(F.col(c), F.col(n).cast("int") + 1, F.size(c))
    parts = cut.withColumns({p: F.slice(a, F.lit(1), F.col(n).cast("int")), ra: rest(a), rb: rest(b)})
    return parts.select(*[F.col(f"`{c}`") for c in others], F.col(n).alias("n_prefix"), render(F.col(p)).alias("prompt"), render(F.col(ra)).alias("chosen_text"), spans(F.col(ra)).alias("chosen_spans"), render(F.col(rb)).alias("rejected_text"), spans(F.col(rb)).alias("rejected_spans"))


def conversations_to_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation id, its turns in order (ties: by role and text). Rows without an id go."""
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def next_replies(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, reply) of conversations with a reply: the last one of the next conversation that has one, by id;
    after the last conversation comes the first. By ranges of ids, which are ordered by themselves."""
    spark = conversations.sparkSession
    last = F.max(F.struct("turn", "text"))
    mine = conversations.where(F.col("conv_id").isNotNull() & (F.col("role") == LEARNT)).groupBy("conv_id").agg(last.getField("text").alias("mine"))
    folder = common.shared_folder(spark, "replies")
    placed = common.kept(mine.repartitionByRange(common.partitions(spark), "conv_id").withColumn("part", F.spark_partition_id()), f"{folder}/placed")
    # One row for each range.
    heads = placed.groupBy("part").agg(F.min_by(F.struct("conv_id", "mine"), "conv_id").alias("head"))
    order = W.orderBy("part")
    heads = common.kept(heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("after")), f"{folder}/heads")
    within = placed.withColumn("following", F.lead(F.struct("conv_id", "mine")).over(W.partitionBy("part").orderBy("conv_id")))
    return within.join(F.broadcast(heads), "part").select("conv_id", F.coalesce("following", "after")["mine"].alias("reply"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs (conv_id, chosen, rejected) of all conversations with a reply: in the rejected one the last reply
    comes from the next conversation that has one, see next_replies().

    A table with one such conversation pairs it with itself. Turns are in the order of turn, role and text; repeated rows are
    repeated turns; rows without an id go. Ids are of any type that has an order.
    """
    whole = conversations_to_turns(conversations).join(next_replies(conversations), "conv_id")
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"].eqNullSafe(F.lit(LEARNT)), i)))
    shown = whole.withColumn("at", at)
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("reply").alias("text"))).otherwise(t))
    return shown.select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


def digest_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, n_prefix, prompt, and text and learnt spans of both completions, for every conversation with a reply; see swapped_replies()."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    done = format_pairs(swapped_replies(conversations))
    return done.select("conv_id", "n_prefix", "prompt", "chosen_text", shown("chosen_spans").alias("chosen_learnt"), "rejected_text", shown("rejected_spans").alias("rejected_learnt"))
