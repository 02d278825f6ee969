"""Conversations: splitting, trimming to a budget, transcripts, and answer critique.

Messages are ``(conv_id, turn, role, text)`` with one row per turn, an optional boolean column
``orphan`` that marks a message answering a tool call, and an optional number ``size`` of characters
where that is not the length of ``text``.  :func:`from_content` makes them from messages of blocks.
``turn`` numbers the messages of a conversation 0, 1, 2 and so on.  Rows without ``conv_id`` or
``turn`` belong to no conversation.  A single conversation may hold a large part of all messages:
boundaries are found by aggregates and by rank limits applied in every task, running sums are taken
block by block, and neighbours meet through an equality join on (conv_id, turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# --- fixed values: sizes and texts -------------------------------------------------------------------
KEEP_RECENT = 6
CHARS_PER_TOKEN = 4
GATE_CHARS_PER_TOKEN = 3
TOOL_RESULT_CHARS = 200
THIN_ANSWER = 40
GIVE_UP_PHRASES = ["i don't know", "i cannot", "as of my knowledge cutoff"]
GAVE_UP = "Gave up or cited a knowledge cutoff instead of using tools/web search."
FLAGGED = "User feedback flagged an issue: "
THIN = "Answer was thin — likely under-explained."
NO_CRITIC = "(No LLM critic available — heuristic review only.)"
PLAIN_LESSON = "Prefer verified, tool-backed answers over assertions; be specific and complete."
LESSON_FROM_FEEDBACK = "When asked something like '%s', verify with tools first and address the user's feedback directly."
SUMMARY_NOTE = "[Summary of %d earlier turns]\n\n%s"
SUMMARY_REPLY = "Understood — continuing from that summary."
TRANSCRIPT_LINE = "%s: %s"
CALLED_TOOL, TOOL_RESULT, IMAGE = "[called tool: %s]", "[tool result: %s]", "[image]"
# -------------------------------------------------------------------------------------------------------

BLOCK = 1_024            # turns per block of a running sum
LINES_PER_TRANSCRIPT = 1_000


def _orphan(messages: DataFrame) -> Column:
    return F.coalesce(F.col("orphan"), F.lit(False)) if "orphan" in messages.columns else F.lit(False)


def _size(messages: DataFrame) -> Column:
    return F.coalesce("size", F.lit(0)) if "size" in messages.columns else F.length(F.coalesce("text", F.lit("")))


def _sizes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, size, orphan): what budgets need to know of the messages, without their texts."""
    return messages.select("conv_id", "turn", _size(messages).alias("size"), _orphan(messages).alias("orphan"))


def recent_starts(messages: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """(conv_id, n_turns, split_turn): the turn at which the kept part begins.

    The last ``keep`` turns are kept; where that part would begin with an answer to a tool call, it
    begins earlier, at the last message that is none.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = (messages.select("conv_id", "turn").withColumn("__rn", F.row_number().over(newest))
            .where(F.col("__rn") <= keep)
            .groupBy("conv_id").agg(F.min("turn").alias("wanted")))
    marked = messages.select("conv_id", "turn", _orphan(messages).alias("__orphan")).join(last, "conv_id")
    return marked.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.coalesce(F.max(F.when((F.col("turn") <= F.col("wanted")) & ~F.col("__orphan"), F.col("turn"))),
                   F.min("turn")).alias("split_turn"))


def split_recent(messages: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """Messages with ``part`` = old or recent."""
    starts = recent_starts(messages, keep).select("conv_id", "split_turn")
    return (messages.join(starts, "conv_id")
            .withColumn("part", F.when(F.col("turn") < F.col("split_turn"), "old").otherwise("recent"))
            .drop("split_turn"))


def rough_sizes(messages: DataFrame, cap_tokens: int) -> DataFrame:
    """Characters per conversation and whether they are few enough to skip counting tokens."""
    sized = messages.groupBy("conv_id").agg(F.sum(_size(messages)).alias("n_chars"))
    return sized.withColumn("needs_no_action", F.col("n_chars") < GATE_CHARS_PER_TOKEN * cap_tokens)


def _suffix_blocks(sized: DataFrame) -> DataFrame:
    """(conv_id, block, chars, after): characters in a block of turns and in the blocks that follow.

    Two levels of blocks: the inner window sees at most BLOCK blocks, the outer one a millionth of
    the turns.
    """
    blocks = sized.groupBy("conv_id", "block").agg(F.sum("size").alias("chars"))
    outer = F.floor(F.col("block") / BLOCK)
    groups = blocks.groupBy("conv_id", outer.alias("outer")).agg(F.sum("chars").alias("outer_chars"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("outer")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("conv_id", "outer", F.coalesce(F.sum("outer_chars").over(later), F.lit(0)).alias("beyond"))
    within = Window.partitionBy("conv_id", "outer").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("outer", outer).withColumn("near", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    return inner.join(groups, ["conv_id", "outer"]).select(
        "conv_id", "block", "chars", (F.col("near") + F.col("beyond")).alias("after"))


def trim_starts(messages: DataFrame, cap_tokens: int) -> DataFrame:
    """(conv_id, first_turn): the first message kept so that the rest fits into the budget.

    Oldest messages go until the remaining characters / 4 fit; the last message always stays, and a
    trimmed conversation does not begin with an answer to a tool call unless nothing else is left.
    Conversations whose characters are fewer than three times the budget are left alone.

    The texts are read once, for their lengths; everything after works on (conv_id, turn, size).
    """
    cap_chars = CHARS_PER_TOKEN * cap_tokens
    sized = materialize(_sizes(messages).withColumn("block", F.floor(F.col("turn") / BLOCK)), "message-sizes")
    blocks = materialize(_suffix_blocks(sized), "message-blocks")
    # The newest block whose own rows cross the budget decides; blocks after it are kept whole.
    totals = blocks.groupBy("conv_id").agg(
        F.sum("chars").alias("n_chars"),
        F.max(F.when(F.col("after") + F.col("chars") > cap_chars, F.col("block"))).alias("edge"))
    edge = totals.where("edge IS NOT NULL").join(blocks.select("conv_id", F.col("block").alias("edge"), "after"),
                                                 ["conv_id", "edge"])
    in_edge = sized.withColumnRenamed("block", "edge").join(edge.select("conv_id", "edge", "after"),
                                                            ["conv_id", "edge"])
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    running = in_edge.withColumn("tail", F.col("after") + F.sum("size").over(newest))
    fits = running.groupBy("conv_id").agg(F.max(F.when(F.col("tail") > cap_chars, F.col("turn"))).alias("too_old"))

    bounds = sized.join(fits, "conv_id", "left").groupBy("conv_id").agg(
        F.min("turn").alias("oldest"), F.max("turn").alias("newest"),
        F.min(F.when((F.col("turn") > F.col("too_old")) & ~F.col("orphan"), F.col("turn"))).alias("head"),
        F.max("too_old").alias("too_old"))
    start = (F.when((F.col("n_chars") < GATE_CHARS_PER_TOKEN * cap_tokens) | F.col("too_old").isNull(),
                    F.col("oldest")).otherwise(F.coalesce("head", "newest")))
    return bounds.join(totals.select("conv_id", "n_chars"), "conv_id").select(
        "conv_id", "n_chars", start.alias("first_turn"))


def trim_to_budget(messages: DataFrame, cap_tokens: int) -> DataFrame:
    """The messages that stay when every conversation is trimmed to the budget."""
    starts = trim_starts(messages, cap_tokens).select("conv_id", "first_turn")
    return messages.join(starts, "conv_id").where(F.col("turn") >= F.col("first_turn")).drop("first_turn")


def transcript_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, line) with lines ``ROLE: body``."""
    line = F.format_string(TRANSCRIPT_LINE, F.upper(F.coalesce("role", F.lit("unknown"))), F.coalesce("text", F.lit("")))
    return messages.select("conv_id", "turn", line.alias("line"))


def block_text(blocks: Column) -> Column:
    """Body of a message made of blocks (type, text, name, content)."""
    def body(b: Column) -> Column:
        result = F.coalesce(b["content"], F.lit(""))
        short = F.when(F.length(result) > TOOL_RESULT_CHARS,
                       F.concat(F.substring(result, 1, TOOL_RESULT_CHARS), F.lit("…"))).otherwise(result)
        return (F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
                .when(b["type"] == "tool_use", F.format_string(CALLED_TOOL, F.coalesce(b["name"], F.lit("?"))))
                .when(b["type"] == "tool_result", F.format_string(TOOL_RESULT, short))
                .when(b["type"] == "image", F.lit(IMAGE)).otherwise(F.lit("")))

    return F.array_join(F.filter(F.transform(blocks, body), lambda t: t != ""), "\n")


def has_tool_result(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))


def from_content(messages: DataFrame) -> DataFrame:
    """Messages from ``content``, JSON text or VARIANT, that is a text or a list of blocks.

    Adds ``text`` (the body as transcripts show it), ``orphan`` (a user message with a tool result) and
    ``size`` (characters of the text, or of the list as JSON).  Members of a list that are no objects and
    blocks of other types show nothing; other JSON is shown as it is; null or unreadable content is empty.
    The schema is found message by message; objects inside a tool result come out in key order.
    """
    whole = dict(messages.dtypes)["content"] == "variant"
    read = messages.withColumn("content", F.col("content") if whole else F.try_parse_json("content"))
    content = F.col("content")
    kind = F.schema_of_variant(content)

    def fields(b: Column) -> Column:
        return F.struct(*[F.try_variant_get(b, f"$.{name}", "string").alias(name) for name in ("type", "text", "name", "content")])

    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), fields)
    listed = F.when(kind.startswith("ARRAY"), blocks)
    plain = F.coalesce(F.try_variant_get(content, "$", "string"), F.lit(""))
    return read.select(
        *[c for c in messages.columns if c not in ("content", "text", "orphan", "size")],
        F.when(listed.isNotNull(), block_text(listed)).otherwise(plain).alias("text"),
        (F.col("role").eqNullSafe(F.lit("user")) & has_tool_result(listed)).alias("orphan"),
        F.length(plain).alias("size"))


def transcripts(messages: DataFrame, lines_per_part: int = LINES_PER_TRANSCRIPT) -> DataFrame:
    """(conv_id, part, transcript): lines joined by blank lines, in parts of bounded length.

    A conversation of at most ``lines_per_part`` turns is one part.  Longer ones continue in the next
    parts, so no task has to hold a whole conversation of unknown length.
    """
    lines = transcript_lines(messages).withColumn("part", F.floor(F.col("turn") / lines_per_part))
    gathered = lines.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("rows"))
    return gathered.select("conv_id", "part", F.array_join(F.col("rows.line"), "\n\n").alias("transcript"))


def condense(messages: DataFrame, summaries: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """Replace the old part of each conversation by a summary pair: (conv_id, position, role, text).

    ``summaries`` (conv_id, summary) come from elsewhere.  Conversations without an old part, or
    without a summary, stay as they are.  Positions count from -2 for the pair and follow the turns.
    """
    starts = recent_starts(messages, keep)
    # turns are numbered from 0, so the turn at which the kept part begins is the number of old ones
    pairs = starts.where("split_turn > 0").select("conv_id", "split_turn").join(summaries, "conv_id")
    header = pairs.select("conv_id", F.inline(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("position"), F.lit("user").alias("role"),
                 F.format_string(SUMMARY_NOTE, "split_turn", "summary").alias("text")),
        F.struct(F.lit(-1).cast("bigint").alias("position"), F.lit("assistant").alias("role"),
                 F.lit(SUMMARY_REPLY).alias("text")))))
    body = (messages.join(pairs.select("conv_id", "split_turn"), "conv_id", "left")
            .where(F.col("split_turn").isNull() | (F.col("turn") >= F.col("split_turn")))
            .select("conv_id", F.col("turn").alias("position"), "role", "text"))
    return header.unionByName(body)


def fit_to_budget(messages: DataFrame, summaries: DataFrame, cap_tokens: int, keep: int = KEEP_RECENT) -> DataFrame:
    """Messages that fit the budget: (conv_id, position, role, text, action).

    A conversation within the budget stays (``keep``).  One beyond it has its old part replaced by a
    summary pair (``condense``); where the pair and the recent part are still too many, the oldest of
    these go as well (``condense_trim``).  One without an old part or without a summary of more than
    blanks is trimmed as it is (``trim``).  Of several summaries of a conversation the first by text
    counts.  Positions are those of :func:`condense`.

    Every decision is taken on sizes; texts are read for their length and once more to be written.
    """
    sized = materialize(_sizes(messages), "budget-sizes")
    over = (sized.groupBy("conv_id").agg(F.sum("size").alias("n_chars"))
            .where(F.col("n_chars") > CHARS_PER_TOKEN * cap_tokens).select("conv_id"))
    usable = summaries.where(F.trim("summary") != "").groupBy("conv_id").agg(F.min("summary").alias("summary"))
    splits = recent_starts(sized, keep).where("split_turn > 0").select("conv_id", "split_turn")
    plan = materialize(over.join(splits.join(usable, "conv_id"), "conv_id", "left").select(
        "conv_id", "split_turn", F.format_string(SUMMARY_NOTE, "split_turn", "summary").alias("note")), "budget-plan")

    condensed = plan.where("split_turn IS NOT NULL")
    pair = F.array(*[F.struct(F.lit(position).cast("bigint").alias("position"), F.lit(role).alias("role"), text.alias("text"))
                     for position, role, text in [(-2, "user", F.col("note")), (-1, "assistant", F.lit(SUMMARY_REPLY))]])
    pairs = condensed.select("conv_id", F.inline(pair))
    recent = sized.join(condensed.select("conv_id", "split_turn"), "conv_id", "left").where(
        F.col("split_turn").isNull() | (F.col("turn") >= F.col("split_turn"))).drop("split_turn")
    candidates = recent.unionByName(pairs.select(
        "conv_id", F.col("position").alias("turn"), F.length("text").alias("size"), F.lit(False).alias("orphan")))

    starts = trim_starts(candidates, cap_tokens).select("conv_id", "first_turn")
    marked = plan.select("conv_id", "split_turn", F.lit(True).alias("over"))
    decided = materialize(starts.join(marked, "conv_id", "left").select(
        "conv_id", "first_turn", F.greatest("first_turn", "split_turn").alias("from_turn"),      # a null split does not count
        F.when(F.col("over").isNull(), "keep").when(F.col("split_turn").isNull(), "trim")
        .when(F.col("first_turn") == -2, "condense").otherwise("condense_trim").alias("action")), "budget-decisions")
    header = pairs.join(decided, "conv_id").where(F.col("position") >= F.col("first_turn"))
    body = (messages.select("conv_id", F.col("turn").alias("position"), "role", "text").join(decided, "conv_id")
            .where(F.col("position") >= F.col("from_turn")))
    kept = ["conv_id", "position", "role", "text", "action"]
    return header.select(*kept).unionByName(body.select(*kept))


def question_answers(messages: DataFrame) -> DataFrame:
    """User messages with the assistant message that follows: (conv_id, turn, question, answer).

    The next message is found by equality on (conv_id, turn), which spreads a long conversation over
    all tasks; a window would put it into one.
    """
    asked = messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = messages.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"])


def critique(pairs: DataFrame) -> DataFrame:
    """Rule-based review of (question, answer, feedback): weaknesses, rating and lesson."""
    answer, feedback = F.coalesce("answer", F.lit("")), F.coalesce("feedback", F.lit(""))
    low = F.lower(answer)
    gave_up = F.lit(False)
    for phrase in GIVE_UP_PHRASES:
        gave_up = gave_up | low.contains(phrase)
    found = F.array_compact(F.array(
        F.when(gave_up, F.lit(GAVE_UP)),
        F.when(feedback != "", F.concat(F.lit(FLAGGED), F.substring(feedback, 1, 200))),
        F.when(F.length(answer) < THIN_ANSWER, F.lit(THIN))))
    asked = F.substring(F.coalesce("question", F.lit("")), 1, 80)
    lesson = F.when(feedback != "", F.format_string(LESSON_FROM_FEEDBACK, asked)).otherwise(F.lit(PLAIN_LESSON))
    weak = F.size("__found") > 0
    return (pairs.withColumn("__found", found)
            .withColumn("rating", F.when(weak, 4).otherwise(6).cast("bigint"))
            .withColumn("weaknesses", F.when(weak, F.col("__found")).otherwise(F.array(F.lit(NO_CRITIC))))
            .withColumn("lesson", lesson).drop("__found"))
