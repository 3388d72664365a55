"""Chat formatting from event logs, with built-in functions only.

A chat is kept as a log of events: streamed deltas, edits and regenerations of its messages. The log is
shuffled by conversation and message, each message's events are sorted by sequence number and folded
into its final text, and the messages of a conversation are sorted and rendered.

Template: each turn is ``<s>role\\ntext</s>``. Control strings inside texts and roles are escaped and come
back exactly: ``<s>``, ``</s>``, ``<|``, ``[INST]``, ``[/INST]`` lose their first
character to ``&lt;`` or ``&#91;``; what already looks like such an escape gets ``&amp;`` for its ``&``.
The loss mask covers the texts of assistant turns, as spans of code points.

Null texts and roles count as empty. Turns are sorted by number, a null one first; rows of the same turn
by role and text; repeated rows are separate messages. Rows with a null conv_id form one conversation.
An empty log gives no rows. Other columns are not read. A conversation's text is one string and its
digest runs over all of it, so a conversation must fit one task, as it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"

_CONTROL_ANGLE = r"<(?=/?s>|\|)"
_CONTROL_BRACKET = r"\[(?=/?INST\])"
_ESCAPED = r"&(?=amp;|lt;|#91;|#10;)"


def escape(text: Column) -> Column:
    """Text in which no control string is left. Null becomes empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPED, "&amp;")
    out = F.regexp_replace(out, _CONTROL_ANGLE, "&lt;")
    return F.regexp_replace(out, _CONTROL_BRACKET, "&#91;")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    for mark, character in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(character))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: each message as its events leave it.

    events: conv_id, message (anything sortable), seq, kind, role, text. A delta appends its text; an
    edit replaces all text before it; a regeneration drops all text before it and begins with its own
    (null: empty). The role is the last one given that is not null. Of equal seq, kinds and then texts
    decide in alphabetical order; other kinds count as deltas.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    folded = events.groupBy("conv_id", "message").agg(log.alias("log"))
    resets = F.transform(
        "log", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i + 1).otherwise(F.lit(1))
    )
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    kept = F.slice(F.col("log"), F.array_max(resets), F.size("log"))
    return folded.select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: one row per conversation.

    messages: conv_id, message, role, text, as ``fold_events`` gives them. loss_spans: turn (from 0),
    turn_start, start and end, code points of ``formatted``, end excluded.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    turns = messages.select(
        "conv_id",
        "message",
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learnt"),
        F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("message")
    placed = turns.withColumn("turn", F.row_number().over(order) - 1).withColumn(
        "turn_start", F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length
    )
    start = F.col("turn_start") + F.char_length("head")
    span = F.struct("turn", "turn_start", start.alias("start"), (start + F.char_length("body")).alias("end"))
    gathered = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("text")))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), span))).alias("loss_spans"),
    )
    return gathered.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("all", lambda t: t["text"]), "").alias("formatted"),
        "loss_spans",
    )


def parse(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role and text of each) and loss_texts, read back from its strings."""
    pieces = F.split("formatted", CLOSE, -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape(F.substring(head, F.lit(len(OPEN) + 1), F.char_length(head))).alias("role"),
            unescape(F.substring(piece, F.char_length(head) + 2, F.char_length(piece))).alias("text"),
        )

    def learnt(span: Column) -> Column:
        piece = F.element_at("pieces", span["turn"] + 1)
        begin, size = span["start"] - span["turn_start"] + 1, span["end"] - span["start"]
        return unescape(F.substring(piece, begin.cast("int"), size.cast("int")))

    cut = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    return cut.select(
        *formatted.columns,
        F.transform("pieces", turn).alias("turns"),
        F.transform("loss_spans", learnt).alias("loss_texts"),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log that writes these rows as a client that streams would. Rows of one turn stay apart.

    Each message begins as a draft of its first half. It is regenerated with its first third, a delta streams the
    second, an edit then gives both again, and a last delta the rest; so each kind of event counts, and the
    draft and what came before the edit must go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id()
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")

    def event(seq: int, kind: str, begin: Column, end: Column) -> Column:
        return F.struct(
            F.lit(seq).cast("long").alias("seq"),
            F.lit(kind).alias("kind"),
            F.substring(F.col("text"), begin + 1, end - begin).alias("text"),
        )

    none = F.lit(0)
    log = F.array(
        event(4, DELTA, 2 * third, size),
        event(3, EDIT, none, 2 * third),
        event(2, DELTA, third, 2 * third),
        event(1, REGENERATE, none, third),
        event(0, DELTA, none, F.floor(size / 2).cast("int")),
    )
    messages = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), row.alias("row")
        ).alias("message"),
        role.alias("role"),
        text.alias("text"),
    )
    return messages.select("conv_id", "message", "role", F.inline(log)).select(
        "conv_id", "message", "seq", "kind", "role", "text"
    )


def digests(parsed: DataFrame) -> DataFrame:
    """What comes back from the formatted strings, as counts and digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
