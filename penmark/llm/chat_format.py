"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut each conversation into turn-aligned windows.
A window holds its own turns, repeats a limited history of the turns before
it and the conversation's opening system turn, and its loss mask covers the
texts of its own assistant turns only; repeated assistant turns are masked
out, so each is learned once.

Template: a window is ``<s>`` followed by turns
``[INST]role[/INST]text</s>``. Inside roles and texts a backslash is doubled
and a backslash is put after the first character of each control string, so
no control string is left in them and ``unescape`` restores them exactly.

Budget: a turn costs its word and sign pieces plus ``TURN_COST``. Windows lie
on a grid of ``(budget - history) / 2`` tokens by the turn's end, so own turns
fit ``budget - history`` unless a single turn alone is larger (a turn is never
cut), and history adds at most ``history``. The system turn comes on top.

Defined cases: null texts and roles are empty; tied turns are ordered by role
and text; repeated rows are turns of their own; null conversation ids form
one conversation; an empty table gives an empty result; other columns are not
read. The prefix sums run in blocks of ``BLOCK`` turn numbers, so a very long
conversation is split over tasks; the turns with their places are written once
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
PIECE = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
TURN_COST = 4
BLOCK = 256
SALTS = 16


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (BOS, EOS, OPEN, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)).cast("long") + F.lit(TURN_COST)


def _turns(conversations: DataFrame, step: int) -> DataFrame:
    rows = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("cost", tokens(F.col("text"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("cost").over(inside)).withColumn("at", F.count(F.lit(1)).over(inside))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
    )
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    end = F.col("c0") + F.col("upto")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    return rows.select(
        "conv_id", (F.col("n0") + F.col("at")).alias("ord"), (end - F.col("cost")).alias("start"),
        F.floor((end - 1) / step).alias("window"), F.length(head).alias("head"),
        F.concat(head, escape(F.col("text")), F.lit(EOS)).alias("piece"),
        (F.col("role") == "assistant").alias("learn"),
        ((F.col("role") == "system") & (F.col("n0") + F.col("at") == 1)).alias("is_system"),
    )


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: ``conv_id``, ``window``, ``n_context`` (leading
    turns that only repeat earlier ones), ``text``, and ``loss``, the list of
    ``start``, ``end`` code points under the loss mask."""
    step = (budget - history) // 2
    if not 0 <= history <= step:
        raise ValueError("history must be at most a third of the budget")
    # read four times below; the prefix sums are computed once
    turns = written(_turns(conversations, step), "chat-turns")
    part = ["ord", "piece", "head"]
    own = turns.select("conv_id", "window", F.lit(False).alias("again"), *part, "learn")

    by_window = Window.partitionBy("conv_id").orderBy("window")
    spans = turns.groupBy("conv_id", "window").agg(F.min("start").alias("from"), F.max("is_system").alias("has_system"))
    spans = spans.withColumn("back", F.array(F.lag("window", 1).over(by_window), F.lag("window", 2).over(by_window)))
    spans = spans.select(F.col("conv_id").alias("s_conv"), F.col("window").alias("s_window"), "from", "has_system", "back")

    back = spans.select("s_conv", "s_window", "from", F.explode("back").alias("b_window")).where(F.col("b_window").isNotNull())
    again = turns.where(~F.col("is_system")).join(
        back,
        F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("window") == F.col("b_window")) & (F.col("from") - F.col("start") <= history),
    )
    again = again.select("conv_id", F.col("s_window").alias("window"), F.lit(True).alias("again"), *part, F.lit(False).alias("learn"))

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    system = turns.where("is_system").select("conv_id", *part, salt)
    later = spans.where(~F.col("has_system"))
    system = later.join(system, F.col("s_conv").eqNullSafe(F.col("conv_id")) & (F.pmod("s_window", F.lit(SALTS)) == F.col("salt")))
    system = system.select("conv_id", F.col("s_window").alias("window"), F.lit(True).alias("again"), *part, F.lit(False).alias("learn"))

    items = own.unionByName(again).unionByName(system).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("ord", "piece", "head", "again", "learn"))).alias("items")
    )
    # (code points before the turn, spans so far); lists are as short as a window
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    none = F.filter(F.array(span), lambda x: x["end"] > 0)
    walked = F.aggregate(
        "items",
        F.struct(F.lit(len(BOS)).alias("pos"), none.alias("loss")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["piece"])).alias("pos"),
            F.when(
                x["learn"],
                F.concat(
                    acc["loss"],
                    F.array(
                        F.struct(
                            (acc["pos"] + x["head"]).alias("start"),
                            (acc["pos"] + F.length(x["piece"]) - F.lit(len(EOS))).alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return items.select(
        "conv_id", "window",
        F.size(F.filter("items", lambda x: x["again"])).cast("long").alias("n_context"),
        F.concat(F.lit(BOS), F.array_join(F.transform("items", lambda x: x["piece"]), "")).alias("text"),
        walked["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The reader: per window its own turns in order (``role``, ``text``,
    unescaped) and the unescaped text under its loss mask."""
    pieces = F.split(F.substring("text", len(BOS) + 1, 2147483647), F.lit(EOS), -1)
    pieces = F.slice(pieces, F.col("n_context").cast("int") + 1, F.size(pieces) - 1 - F.col("n_context").cast("int"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, CLOSE, 1)
        text = piece.substr(F.length(head) + F.lit(len(CLOSE) + 1), F.length(piece))
        return F.struct(unescape(F.substring(head, len(OPEN) + 1, 2147483647)).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"),
        F.array_join(masked, "").alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"),
    )


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what the windows say. A digest
    of a whole conversation needs its text in one row; only here, not in the
    windows."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_windows(windows).select("conv_id", "window", F.size("turns").cast("long").alias("n"), turns.alias("said"), "loss_text", "formatted_chars")
    rows = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss_text"))).alias("all"),
    )
    said = F.array_join(F.transform("all", lambda x: x["said"]), "")
    loss = F.array_join(F.transform("all", lambda x: x["loss_text"]), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
