"""Chat formatting from an event log, with DataFrame functions alone.

Events are partitioned by conversation and message, sorted by sequence and folded into final messages: a ``message``
opens a message, a ``delta`` appends to it, an ``edit`` replaces its text, and a ``regenerate`` discards what was
streamed so far and starts again with its own text. Final messages are rendered in turn order:

    <turn:ROLE>TEXT</turn>\\n

Inside ROLE and TEXT, ``\\`` is written ``\\s``, ``<`` is ``\\l`` and ``>`` is ``\\g``, so neither can hold a marker, and reading
undoes this exactly. The loss mask lists the code-point ranges of assistant texts in the formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role and text of each message after all its events.

    events: conv_id, seq, kind, turn, copy, role, text. Events of a message are folded in order of seq (ties: kind,
    role, text); an unknown or null kind counts as ``message``. The text is everything from the last event that starts
    afresh (message, edit, regenerate); without one, all deltas. The role is the last one that is not null, else empty.
    Null texts are empty.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.lit("message"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", kind.alias("kind"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    folded = events.groupBy("conv_id", "turn", "copy").agg(ordered.alias("log"))
    # the place of the last fresh start: array_position counts from 1 in the reversed log
    back = F.array_position(F.reverse(F.transform(F.col("log"), lambda e: e["kind"] != "delta")), True)
    live = F.when(back > 0, F.slice(F.col("log"), -back, back)).otherwise(F.col("log"))
    roles = F.filter(F.transform(F.col("log"), lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select("conv_id", "turn", "copy", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (start and end in code points) of each conversation.

    A conversation's output is one string, so a conversation is the unit of work here; rows of a conversation without
    messages do not exist.
    """
    each = Window.partitionBy("conv_id").orderBy("turn", "copy").rowsBetween(Window.unboundedPreceding, -1)
    body = escape(F.col("text"))
    rows = messages.select("conv_id", "turn", "copy", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), body.alias("body"))
    rows = rows.withColumns({"size": F.length("head") + F.length("body") + len(CLOSE)})
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(each), F.lit(0)) + F.length("head"))
    turn = F.struct("turn", "copy", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == LOSS_ROLE, F.struct("start", (F.col("start") + F.length("body")).alias("end"))).alias("loss"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each, in order), loss_text and formatted_chars from rendered conversations alone."""
    pieces = F.split(F.col("formatted"), r"</turn>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 1)).alias("role"), unescape(F.substring_index(p, MIDDLE, -1)).alias("text")))
    under = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def message_events(conversations: DataFrame) -> DataFrame:
    """The table (conv_id, turn, role, text) as a log of whole messages; rows that share a turn are messages of their own."""
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", copy.alias("copy"), "role", "text")


def digest(turns: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
