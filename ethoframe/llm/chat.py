"""Chat formatting: conversations as training windows within a token budget, with a loss mask.

The template marks a turn as ``<s>[role]`` + line end + text + ``</s>`` + line end. Inside roles and texts a backslash, ``<``, ``[`` and, in roles, a line end are
written as ``\\e``, ``\\l``, ``\\b`` and ``\\n``; no control string of this or another template can appear in a text, and the escape is
reversible.

Windows: prefix sums of turn tokens (white-space words, at least 1) cut a conversation into turn-aligned spans. Half of what the budget leaves
after the system turn and the history is the stride. A turn longer than the stride has a window of its own; the others stand with those
whose prefix sum falls into the same multiple of the stride, so that they take less than two strides. Every window after the first begins with the
leading system turn and repeats at most ``history_turns`` turns, each only while the tokens of the history stay within ``history_tokens`` and the
window within the budget; what is repeated is outside the loss mask. No turn is cut: a window exceeds the budget only if one turn, with the
system turn, does.

Nulls and edges: a null text or role is empty; turns sort by turn (null first), then role and text; repeated rows are turns of
their own; rows with a null conv_id form one conversation; an empty table gives no windows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<s>[", "</s>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """The inverse: every backslash of an escaped text begins a pair, so pairs can be undone one kind after the other, the backslash last."""
    for plain, code in reversed(ESCAPES if role else ESCAPES[:3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_windows(conversations: DataFrame, budget: int = 2048, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, new_from (turns of the text before it are repeated), loss_spans.

    loss_spans holds (start, length) in characters of ``formatted``, one per assistant turn that is new in the window.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.col("turn"), role.alias("role"), text.alias("text"))
    tokens = F.greatest(F.lit(1), F.size(F.array_remove(F.split("text", r"\s+", -1), ""))).cast("long")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("]\n"))
    turns = turns.withColumns({"tokens": tokens, "head": head, "body": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("*", F.row_number().over(order).alias("n"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("sum_before"))
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.struct("role", "tokens", "head", "body")
    turns = turns.withColumn("lead", F.first(F.when(F.col("role") == "system", lead)).over(first))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.coalesce(F.col("lead.tokens"), F.lit(0)) - history_tokens) / 2))
    turns = turns.withColumns({"part": F.floor(F.col("sum_before") / stride), "alone": F.col("tokens") > stride})
    fresh = (F.col("n") == 1) | F.col("alone") | F.lag("alone").over(order) | (F.col("part") != F.lag("part").over(order))
    turns = turns.withColumn("starts", fresh)
    turns = turns.withColumn("window", F.sum(F.col("starts").cast("long")).over(first) - 1)
    # each turn brings the history that its window would repeat if the turn came first in it
    past = order.rowsBetween(-history_turns, -1)
    history = F.collect_list(F.struct("n", "role", "tokens", "head", "body")).over(past) if history_turns else F.array().cast("array<struct<n:int,role:string,tokens:bigint,head:string,body:string>>")
    turns = turns.select("*", F.when(F.col("starts") & (F.col("n") > 1), history).alias("history"))
    piece = F.struct("n", "role", F.concat("head", "body", F.lit(CLOSE)).alias("whole"), F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars"))
    grouped = turns.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.min("n").alias("first_n"), F.min_by("history", "n").alias("history"), F.min_by("lead", "n").alias("lead"), F.sum("tokens").alias("new_tokens")
    )
    system = F.col("lead").isNotNull() & (F.col("first_n") > 1)
    left = F.least(F.lit(history_tokens), F.lit(budget) - F.col("new_tokens") - F.when(system, F.col("lead.tokens")).otherwise(0))
    # the nearest history turns whose tokens fit, without the system turn, which stands before them anyway
    kept = F.filter(
        F.coalesce(F.col("history"), F.array()),
        lambda h: (F.aggregate(F.filter("history", lambda g: g["n"] >= h["n"]), F.lit(0).cast("long"), lambda s, g: s + g["tokens"]) <= left) & ~(system & (h["n"] == 1)),
    )
    repeated = F.concat(
        F.when(system, F.concat("lead.head", "lead.body", F.lit(CLOSE))).otherwise(""),
        F.array_join(F.transform(kept, lambda h: F.concat(h["head"], h["body"], F.lit(CLOSE))), ""),
    )
    grouped = grouped.withColumn("repeated", repeated).withColumn("new_from", F.char_length("repeated"))
    acc = F.struct(F.col("new_from").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        add = F.struct((a["at"] + p["head_chars"]).alias("start"), p["body_chars"].alias("length"))
        spans = F.when(p["role"] == "assistant", F.concat(a["spans"], F.array(add))).otherwise(a["spans"])
        return F.struct((a["at"] + F.char_length(p["whole"])).alias("at"), spans.alias("spans"))

    return grouped.select(
        "conv_id", "window", F.concat("repeated", F.array_join(F.transform("pieces", lambda p: p["whole"]), "")).alias("formatted"),
        "new_from", F.aggregate("pieces", acc, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text, unescaped, without what the window repeats), loss (the texts under the mask, in order)."""
    new = F.expr("substring(formatted, new_from + 1)")
    # a text holds no '<', so the closing mark cannot stand inside one
    parts = F.filter(F.split(new, "</s>\n", -1), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**30), "]\n", 1), role=True)
    turns = F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescape(_after(p)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("chars"))


def _after(part: Column) -> Column:
    return F.substring(part, F.instr(part, "]\n") + 2, F.lit(2**30))
