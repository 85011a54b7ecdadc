"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens deal a conversation's turns to spans: a turn belongs to the span in
whose stride its first token falls. A window is the leading system turn, the last turns before
the span whose tokens fit the history budget, and the span itself. Only the span's assistant turns
are targets; what is repeated is masked, so each target counts once.

A turn is written as `<turn role="R">`, a newline, the text, `</turn>` and a newline, or
`<turn>` for a null role. `&`, `<`, `>` and `"` in texts and roles are written as entities, so no
text can hold a control string, and reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is escaped, `&` first; undone in the opposite order.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
TURN = r'<turn(?: role="([^"<>]*)")?>\n([^<>]*)</turn>\n'


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ENTITIES[::-1], text)


def windows(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    stride: int = 384,
    history: int = 128,
) -> DataFrame:
    """(conv_id, window, formatted, n_context, n_tokens, loss): loss is an array of (start, length) in
    code points of formatted, in order; the first n_context turns are repeats.

    Tokens are runs without white space, as in escaped texts. A window's span holds less than
    `stride` tokens before its last turn. Turns stand by `turn`, nulls first, then by role and text;
    repeated rows are turns of their own. A null conv_id is a conversation, a null text is
    empty, extra columns are ignored. Empty tables give no window.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    safe = escaped(F.col("_text"))
    rows = rows.withColumn("_open", F.concat(F.lit("<turn"), F.coalesce(F.concat(F.lit(' role="'), escaped(F.col("_role")), F.lit('"')), F.lit("")), F.lit(">\n")))
    rows = rows.withColumns({"_piece": F.concat("_open", safe, F.lit("</turn>\n")), "_n": F.regexp_count(safe, F.lit(r"\S+"))})
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), "_text")
    rows = rows.withColumns({"_at": F.row_number().over(order), "_before": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")})
    span = F.floor(F.col("_before") / stride)
    rows = rows.withColumn("_span", span)
    opens = F.coalesce(F.lag("_span").over(order) != F.col("_span"), F.lit(True))
    is_system = (F.col("_at") == 1) & F.col("_role").eqNullSafe(F.lit("system"))
    rows = rows.withColumn("_opens", F.when(opens, F.struct("_span", "_before")))
    # read backwards, the last opening before a turn is that of the span after its own
    back = Window.partitionBy("conv_id").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_next": F.last("_opens", ignorenulls=True).over(back), "_system": F.first(F.when(is_system, F.struct("_piece", "_n"))).over(order)})
    repeats = F.col("_next").isNotNull() & ~is_system & (F.col("_next._before") - F.col("_before") <= history)
    own = F.struct(F.col("_span").alias("window"), F.lit(True).alias("own"))
    again = F.struct(F.col("_next._span").alias("window"), F.lit(False).alias("own"))
    rows = rows.withColumn("_w", F.explode(F.when(repeats, F.array(own, again)).otherwise(F.array(own))))
    rows = rows.select("conv_id", F.col("_w.window").alias("window"), F.col("_w.own").alias("own"), "_at", "_role", "_piece", "_open", "_n", "_system")
    inside = Window.partitionBy("conv_id", "window").orderBy("_at")
    lead = F.when(F.first("_at").over(inside) > 1, F.coalesce(F.length(F.col("_system._piece")), F.lit(0))).otherwise(0)
    start = lead + F.sum(F.length("_piece")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_piece") + F.length("_open")
    rows = rows.withColumn("_start", start.cast("long"))
    length = (F.length("_piece") - F.length("_open") - len("</turn>\n")).cast("long")
    target = F.col("own") & F.col("_role").eqNullSafe(F.lit("assistant"))
    made = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(target, F.struct(F.col("_start").alias("start"), length.alias("length"))))).alias("loss"),
        F.sum(F.when(F.col("own"), 0).otherwise(1)).alias("_repeated"),
        F.sum("_n").alias("_tokens"),
        F.first("_system").alias("_system"),
    )
    led = F.col("_system").isNotNull() & (F.col("_pieces")[0]["_at"] > 1)
    body = F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "")
    return made.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.concat(F.when(led, F.col("_system._piece")).otherwise(""), body).alias("formatted"),
        (F.col("_repeated") + led.cast("int")).cast("int").alias("n_context"),
        (F.col("_tokens") + F.when(led, F.col("_system._n")).otherwise(0)).cast("long").alias("n_tokens"),
        "loss",
    )


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), from windows(): the turns of each conversation in order as
    (role, text), and all text under the loss mask, unescaped."""
    found = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    own = F.slice(found, F.col("n_context") + 1, F.greatest(F.size(found) - F.col("n_context"), F.lit(0)))

    def parsed(piece: Column) -> Column:
        role = F.when(piece.rlike(r'^<turn role="'), unescaped(F.regexp_extract(piece, TURN, 1)))
        return F.struct(role.alias("role"), unescaped(F.regexp_extract(piece, TURN, 2)).alias("text"))

    masked = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    rows = made.select("conv_id", "window", F.transform(own, parsed).alias("_turns"), unescaped(masked).alias("_loss"), F.length("formatted").alias("_chars"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "_turns", "_loss"))).alias("_w"), F.sum("_chars").alias("formatted_chars"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("_w", lambda w: w["_turns"])).alias("turns"),
        F.array_join(F.transform("_w", lambda w: w["_loss"]), "").alias("loss_text"),
        "formatted_chars",
    )


def digests(read: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation read back."""
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
