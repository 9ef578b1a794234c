"""Chat formatting: fold an event log into final messages and render them.

A conversation is a log of events, each about one message of it (``message``), in
the order of ``seq``:

* ``start``       begins the message, with ``role``, its ``turn`` and maybe some text
* ``delta``       appends streamed text
* ``edit``        replaces all text so far
* ``regenerate``  drops all text so far; deltas follow

The log is partitioned by conversation and sorted by sequence; what counts of a message
is its last replacing event and the deltas after it. Messages are ordered by turn
and rendered with a template that marks turns. Only DataFrame functions are used: a
shuffle by conversation serves the fold, the rendering and the loss spans.

Control strings in texts and roles are escaped: a backslash becomes ``\\0``, ``<|``
becomes ``\\1`` and in roles a line break ``\\2``; so ``<|`` only ever occurs in marks.

A conversation becomes one row, so its text must fit one; that is its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

REPLACING = ("start", "edit", "regenerate")


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\2"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\2"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, message, role, text`` of ``events(conv_id, message, seq, kind, turn,
    role, text)``: one row per message, its final text.

    An event of an unknown kind or with null ``seq`` is left out; equal ``seq`` are ordered by
    kind and text. Null text is empty. A message whose log has no ``start`` has a null
    turn and role. Output is partitioned by conv_id.
    """
    known = events.filter(F.col("kind").isin(*REPLACING, "delta") & F.col("seq").isNotNull())
    e = known.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "kind", "turn", "role",
                     F.when(F.col("kind") != "regenerate", _text("text")).otherwise("").alias("text"))
    # partitioned once, by conversation: messages and conversations both group within it
    log = e.repartition("conv_id").groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
        F.max_by("turn", F.when(F.col("kind") == "start", F.col("seq"))).alias("turn"),
        F.max_by("role", F.when(F.col("kind") == "start", F.col("seq"))).alias("role"))
    last = F.coalesce(F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i))), F.lit(0))
    return log.select("conv_id", "turn", "message", "role", F.array_join(
        F.transform(F.slice("log", last + 1, F.size("log")), lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages, formatted, loss_spans`` of ``messages(conv_id, turn, message, role,
    text)``: one row per conversation.

    Messages are ordered by turn (null first), then role, text and message. loss_spans are
    ``(start, length)`` in code points of ``formatted``, counted from 0: the escaped texts of
    assistant messages. Null role and text are empty.
    """
    role, body = escape_role(_text("role")), escape(_text("text"))
    head, tail = F.concat(F.lit(OPEN), role, F.lit("\n")), F.lit(CLOSE + "\n")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "message")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("head") + F.char_length("body") + len(CLOSE) + 1
    placed = (
        messages.select("conv_id", "turn", "role", "text", "message", head.alias("head"), body.alias("body"),
                        (_text("role") == LOSS_ROLE).alias("loss"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.char_length("head"))
        .withColumn("part", F.concat("head", "body", tail))
    )
    part = F.struct("place", "part", "loss", "start", F.char_length("body").cast("long").alias("length"))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "conv_id", F.size("parts").cast("long").alias("n_messages"),
        F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))
                    ).alias("loss_spans"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render; an empty log gives an empty result, other columns are ignored."""
    return render(fold(events))


def parsed(formatted: str = "formatted") -> Column:
    """The turns of a rendered text, as an array of (role, text), read from it alone."""
    turns = F.slice(F.split(F.col(formatted), r"<\|im_end\|>\n"), 1, F.size(F.split(F.col(formatted), r"<\|im_end\|>\n")) - 1)
    return F.transform(turns, lambda x: F.struct(
        unescape_role(F.substring(x, len(OPEN) + 1, F.locate("\n", x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, F.locate("\n", x) + 1, F.char_length(x))).alias("text")))


def under_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss spans of a rendered text, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log of stored ``conversations(conv_id, turn, role, text)``, as the messages
    could have been written: replies are streamed, thrown away once and streamed again in
    two deltas; others are first a draft, then edited. Each row is a message."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event("start", F.lit("")), event("delta", first), event("regenerate", F.lit("")),
                       event("delta", first), event("delta", second))
    edited = F.array(event("start", first), event("edit", F.col("text")))
    rows = conversations.select("conv_id", "turn", "role", _text("text").alias("text"),
                                F.monotonically_increasing_id().alias("message"))
    return rows.select("conv_id", "message", "turn", "role", F.posexplode(
        F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(edited)).alias("step", "e")).select(
        "conv_id", "message", F.col("step").alias("seq"), "e.kind", "turn", "role", "e.text")
