"""Chat formatting with quotation linking, in DataFrame operations only.

A message's lines carry quote levels; lines of one level that follow each other are a passage. Passages, their
sentences and their lines are hashed with case and white space folded, so a quotation that was wrapped anew, or cut
down to a sentence, still has a hash in common with the message it came from. Quotes are linked by a join on
conversation and hash, cut from the bodies, and the messages are put together in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own_columns, written

#: One or more quote marks at the start of a line, as mail and chat clients write nested quotes.
QUOTE = "^[ \\t]*((?:>[ \\t]?)+)"
#: Messages of one assembled segment, and turns whose chains are followed together.
SEGMENT, BLOCK_TURNS = 256, 65_536
#: What a hash is of, best evidence first.
PASSAGE, SENTENCE, LINE = 0, 1, 2


def normalised(line: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def passages(text: Column) -> Column:
    """Array of (level, lines): maximal runs of lines of one quote level; blank lines and bare marks end a run."""

    def marked(line: Column) -> Column:
        marks = F.regexp_extract(line, QUOTE, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), normalised(F.regexp_replace(line, QUOTE, "")).alias("content"))

    def runs(lines: Column) -> Column:
        def begins(line: Column, i: Column) -> Column:
            last = F.get(lines, i - 1)
            return (line["content"] != "") & ((i == 0) | (last["content"] == "") | (last["level"] != line["level"]))

        def cut(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                length = F.coalesce(F.get(starts, k + 1), F.size(lines)) - start
                held = F.filter(F.slice(lines, start + 1, length), lambda x: x["content"] != "")
                return F.struct(F.get(lines, start)["level"].alias("level"), F.transform(held, lambda x: x["content"]).alias("lines"))

            return F.transform(starts, run)

        at = F.transform(lines, lambda x, i: F.when(begins(x, i), i))
        return F.get(F.transform(F.array(F.filter(at, lambda i: i.isNotNull())), cut), F.lit(0))

    return F.get(F.transform(F.array(F.transform(F.split(text, "\n"), marked)), runs), F.lit(0))


def units(lines: Column) -> Column:
    """Array of (kind, hash): the passage as a whole, its sentences and its lines."""
    whole = F.array_join(lines, " ")
    sentences = F.split(F.regexp_replace(whole, "([.!?]) ", "$1\n"), "\n")

    def of(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("hash")))

    return F.array_distinct(F.concat(of(PASSAGE, F.array(whole)), of(SENTENCE, sentences), of(LINE, lines)))


def passage_units(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv, turn, nth passage, level, kind, hash) of the quoted or the unquoted passages of each message."""
    runs = messages.select("conv", "turn", F.posexplode(F.filter(passages(F.col("text")), lambda p: (p["level"] > 0) == F.lit(quoted))).alias("nth", "run"))
    return runs.select("conv", "turn", "nth", F.col("run.level").alias("level"), F.explode(units(F.col("run.lines"))).alias("unit")).select("conv", "turn", "nth", "level", "unit.*")


@own_columns
def chat_format(
    conversations: DataFrame,
    template: str = "<|%s|>\n%s",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each message, its quotes resolved.

    Adds ``body`` (the text without quoted lines), ``reply_to`` (the turn it answers), ``n_quoted`` and ``n_linked``
    (quoted passages, and those linked), ``max_quote_level`` and ``formatted``. A passage quoted at level 1 or deeper
    is linked to the first earlier message of its conversation that wrote it, or failing that one of its sentences or
    lines, unquoted; ``reply_to`` is the latest turn among the links of its shallowest linked level, else the turn
    before it, null for a first turn. A reply's turn is above its target's.

    Nulls: a null text is an empty body, a null role is written as an empty one; rows with a null conversation
    or turn are returned unlinked. Repeated rows are returned each, with equal links; messages that share a turn
    have the links of all of them. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    added = ["body", "reply_to", "n_quoted", "max_quote_level", "n_linked", "formatted"]
    conversations = conversations.drop(*added)
    keyed = conversations.withColumns({"_lm_conv": F.col(conv_col).cast("string"), "_lm_turn": F.col(turn_col).cast("long"), "_lm_text": F.coalesce(F.col(text_col), F.lit(""))})
    messages = keyed.select(F.col("_lm_conv").alias("conv"), F.col("_lm_turn").alias("turn"), F.col("_lm_text").alias("text")).filter("conv is not null and turn is not null")
    quoting = written(
        passage_units(messages.filter(F.regexp_like("text", F.lit("(?m)" + QUOTE))).withColumn("message", F.xxhash64("text")).dropDuplicates(["conv", "turn", "message"]), True)
    )
    # Of all messages only what somebody quotes is looked up; each (conversation, hash) is one row.
    wanted = quoting.select("conv", "hash").distinct()
    originals = passage_units(messages, False).join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    found = quoting.join(originals, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    best = F.min(F.when(F.col("origin").isNotNull(), F.struct("kind", "origin")))["origin"]
    linked = found.groupBy("conv", "turn", "nth", "level").agg(best.alias("origin"))
    links = linked.groupBy(F.col("conv").alias("_lm_conv"), F.col("turn").alias("_lm_turn")).agg(
        F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("level"), F.col("origin").alias("origin"))))["origin"].alias("_lm_origin"),
        F.count(F.lit(1)).alias("n_quoted"),
        F.max("level").cast("long").alias("max_quote_level"),
        F.count("origin").alias("n_linked"),
    )
    before = messages.select("conv", "turn").distinct().select(F.col("conv").alias("_lm_conv"), (F.col("turn") + 1).alias("_lm_turn"), F.col("turn").alias("_lm_before"))
    body = F.trim(F.array_join(F.filter(F.split("_lm_text", "\n"), lambda x: ~F.regexp_like(x, F.lit(QUOTE))), "\n"))
    return (
        keyed.join(links, ["_lm_conv", "_lm_turn"], "left")
        .join(before, ["_lm_conv", "_lm_turn"], "left")
        .withColumn("_lm_body", body)
        .select(
            *conversations.columns,
            F.col("_lm_body").alias("body"),
            F.coalesce("_lm_origin", "_lm_before").alias("reply_to"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "max_quote_level", "n_linked")],
            F.format_string(template, F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.col("_lm_body")).alias("formatted"),
        )
    )


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0: where each stands in its group by ``order``.

    Rows are sorted by ranges over groups and order, so a large group is many tasks' work; each range numbers its own,
    and starts behind what earlier ranges hold of the group.
    """
    held = written(rows.repartitionByRange(*group, *order).withColumn("_lm_range", F.spark_partition_id()))
    counts = held.groupBy(*group, "_lm_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("_lm_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = counts.select(*group, "_lm_range", F.coalesce(before, F.lit(0)).alias("_lm_before"))
    nth = F.row_number().over(Window.partitionBy(*group, "_lm_range").orderBy(*order)) - 1
    return held.withColumn("_lm_nth", nth).join(starts, [*group, "_lm_range"]).withColumn("place", F.col("_lm_before") + F.col("_lm_nth")).drop("_lm_range", "_lm_before", "_lm_nth")


def threads(turns: DataFrame) -> DataFrame:
    """(conv, turn, path) of ``turns(conv, turn, reply_to)``: paths in whose order a reply follows what it answers.

    A run of turns that each answer the one before is a chain. Order is that of a walk through the replies, answers of a
    message in order of turn and each with all that follows from it: a chain first, then what branches off it, from its
    latest message back to its earliest. A path has an element for each branch that leads to a chain.
    """
    head = F.when(F.col("reply_to").isNull() | (F.col("reply_to") != F.col("turn") - 1), F.col("turn"))
    blocks = turns.withColumns({"own": head, "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    inside = Window.partitionBy("conv", "block").orderBy("turn")
    found = blocks.withColumn("first", F.max("own").over(inside))
    last = blocks.groupBy("conv", "block").agg(F.max("own").alias("last"))
    earlier = F.max("last").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    chained = found.join(last.select("conv", "block", earlier.alias("carried")), ["conv", "block"]).select("conv", "turn", "reply_to", F.coalesce("first", "carried").alias("chain"))
    chained = written(chained)
    of_target = chained.select("conv", F.col("turn").alias("reply_to"), F.col("chain").alias("up"))
    heads = chained.filter("turn = chain").select("conv", "turn", "reply_to").join(of_target, ["conv", "reply_to"], "left")
    element = F.struct(F.coalesce(-F.col("reply_to"), F.lit(0)).cast("long").alias("off"), F.col("turn").alias("turn"))
    state = written(heads.select("conv", F.col("turn").alias("chain"), "up", F.array(element).alias("path")))
    while not state.filter("up is not null").isEmpty():  # twice as many branches in each round
        above = state.select("conv", F.col("chain").alias("up"), F.col("up").alias("upper"), F.col("path").alias("leading"))
        stepped = state.join(above, ["conv", "up"], "left")
        state = written(stepped.select("conv", "chain", F.col("upper").alias("up"), F.when(F.col("leading").isNull(), F.col("path")).otherwise(F.concat("leading", "path")).alias("path")))
    return chained.join(state.select("conv", "chain", "path"), ["conv", "chain"]).select("conv", "turn", "path")


def assembled(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations in reply order out of what ``chat_format`` returns: a row for each segment of a conversation.

    Messages stand in order of their threads (see ``threads``), those that share a turn in order of their text; equal
    ones count once. A segment is the next ``SEGMENT`` messages of that order, so no group is collected without bound and
    no message is ever put out of it. Rows without a conversation are a conversation of their own (null), and those
    without a turn stand first. Columns: the conversation, ``segment``, ``n_messages``, ``n_quoted``, ``n_linked``,
    ``replies`` ("turn>reply_to", in order) and ``text``.
    """
    turn = F.col(turn_col).cast("long")
    rows = written(formatted.select(conv_col, F.col(conv_col).cast("string").alias("conv"), turn.alias("turn"), "formatted", "reply_to", "n_quoted", "n_linked").distinct())
    known = rows.filter("conv is not null and turn is not null").select("conv", "turn", "reply_to").distinct()
    placed = rows.join(threads(known), ["conv", "turn"], "left")
    ordered = placed.withColumns({"conv": F.coalesce("conv", F.lit("")), "unknown": F.col("conv").isNull()})
    found = numbered(ordered, ["unknown", "conv"], ["path", "turn", "formatted", "reply_to"])
    of = found.groupBy(conv_col, F.floor(F.col("place") / SEGMENT).cast("long").alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "formatted", "reply_to"))).alias("messages"),
        F.count(F.lit(1)).alias("n_messages"),
        F.sum("n_quoted").alias("n_quoted"),
        F.sum("n_linked").alias("n_linked"),
    )
    said = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return of.select(
        conv_col,
        "segment",
        "n_messages",
        "n_quoted",
        "n_linked",
        F.array_join(F.transform("messages", lambda m: F.concat(said(m["turn"]), F.lit(">"), said(m["reply_to"]))), " ").alias("replies"),
        F.array_join(F.transform("messages", lambda m: m["formatted"]), "\n").alias("text"),
    )
