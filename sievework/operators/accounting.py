"""Accounting over logs: usage and cost, evaluation scores, notes and lessons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: limits and default price ---------------------------------------------------------
DEFAULT_INPUT_PRICE, DEFAULT_OUTPUT_PRICE = 3.00, 15.00  # per million tokens
PASS_THRESHOLD = 0.7
GATED_METRICS = ["faithfulness", "relevance"]
RECENT_LESSONS = 12
FOUND_LESSONS = 5
QUESTION_CHARS = 300
MIN_TERM_CHARS = 4
FAILURE_LINE = "%s — %s=%s"
DIGEST_ITEM = "(%d) %s"
# ------------------------------------------------------------------------------------------------------

TOTAL = "(all)"


# --- usage ------------------------------------------------------------------------------------------------

def usage_by_model(usage: DataFrame) -> DataFrame:
    """Calls and tokens per model; a hot model is one row per task when shuffled."""
    return usage.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Per model and over all models; cache tokens are kept for the total only.

    The rollup runs over the per-model sums, so the log itself is not expanded.
    """
    sums = [F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    is_total = F.grouping("model") == 1
    cache = [F.when(is_total, F.sum(c)).alias(c) for c in ("cache_read", "cache_write")]
    return (usage_by_model(usage).rollup("model").agg(*sums, *cache, F.grouping("model").alias("g"))
            .withColumn("model", F.when(F.col("g") == 1, TOTAL).otherwise(F.col("model"))).drop("g"))


def model_costs(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost per model; models without a price use the default.  Joined after the sums, one row a model."""
    priced = usage_by_model(usage).join(pricing, "model", "left")
    return priced.select("model", "calls", _cost().alias("cost_usd"))


def _cost() -> Column:
    return (F.col("input_tokens") / 1e6 * F.coalesce("input_price", F.lit(DEFAULT_INPUT_PRICE))
            + F.col("output_tokens") / 1e6 * F.coalesce("output_price", F.lit(DEFAULT_OUTPUT_PRICE)))


def priced_usage(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls, tokens, cost and time of the last call per model from one scan of the log."""
    last = usage.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")],
        F.max("ts").alias("last_call"))
    return last.join(pricing, "model", "left").select(
        "model", "calls", "input_tokens", "output_tokens", "cache_read", "cache_write", "last_call",
        _cost().alias("cost_usd"))


def cost_summary(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost and calls per model and in total, four decimals."""
    return (model_costs(usage, pricing).rollup("model")
            .agg(F.sum("calls").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
                 F.grouping("model").alias("g"))
            .withColumn("model", F.when(F.col("g") == 1, TOTAL).otherwise(F.col("model"))).drop("g"))


def conversation_tokens(usage: DataFrame) -> DataFrame:
    """Token totals per conversation."""
    return usage.groupBy("conv_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"))


# --- evaluation ----------------------------------------------------------------------------------------------

def metric_means(scores: DataFrame) -> DataFrame:
    """Mean per metric over the scores that are there."""
    return scores.groupBy("metric").agg(F.avg("score").alias("mean"), F.count("score").alias("n_scored"))


def scores_per_example(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per example with a column per metric."""
    return scores.groupBy("example_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m)
                                              for m in metrics])


def gate_failures(scores: DataFrame, gates: list[str] | None = None,
                  threshold: float = PASS_THRESHOLD) -> DataFrame:
    """(example_id, gate, score) below the threshold; an absent score counts as 0."""
    gates = gates or GATED_METRICS
    wide = scores_per_example(scores, gates)
    pairs = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("score")) for g in gates])
    return (wide.select("example_id", F.inline(pairs))
            .where(F.coalesce("score", F.lit(0.0)) < threshold))


def gate_summary(scores: DataFrame, gates: list[str] | None = None, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """Examples, failing (example, gate) pairs and whether the run passed, in one row."""
    wide = scores_per_example(scores, gates or GATED_METRICS)
    failing = reduce(lambda a, b: a + b, [F.count_if(F.coalesce(g, F.lit(0.0)) < threshold)
                                          for g in gates or GATED_METRICS])
    return (wide.agg(F.count(F.lit(1)).alias("n_examples"), failing.alias("n_failures"))
            .withColumn("passed", F.col("n_failures") == 0))


def failure_lines(failures: DataFrame, questions: DataFrame) -> DataFrame:
    """Failures as text; questions: (example_id, question)."""
    shown = F.coalesce(F.col("score").cast("string"), F.lit("None"))
    return failures.join(questions, "example_id").select(
        "example_id", "gate", F.format_string(FAILURE_LINE, F.substring("question", 1, 48), "gate", shown).alias("line"))


# --- notes ---------------------------------------------------------------------------------------------------

def latest_notes(log: DataFrame) -> DataFrame:
    """Latest value per key: (key, value, updated_at).

    log: (key, value, updated_at, seq); ``seq`` decides between equal times.  The newest entry is
    chosen in every task first, so a key rewritten without end stays one row per task.
    """
    newest = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "seq")).alias("entry")
    return log.groupBy("key").agg(newest).select("key", "entry.value", "entry.updated_at")


def notes_listing(log: DataFrame) -> DataFrame:
    return latest_notes(log).orderBy("key")


# --- lessons ---------------------------------------------------------------------------------------------------

def recent_lessons(lessons: DataFrame, n: int = RECENT_LESSONS) -> DataFrame:
    """The last n lessons, oldest first: (position, lesson_id, ts, lesson)."""
    newest = lessons.orderBy(F.desc("ts"), F.desc("lesson_id")).limit(n).select("lesson_id", "ts", "lesson")
    row = newest.agg(F.sort_array(F.collect_list(F.struct("ts", "lesson_id", "lesson"))).alias("rows"))
    return row.select(F.posexplode("rows").alias("position", "r")).select(
        (F.col("position") + 1).cast("bigint").alias("position"), "r.lesson_id", "r.ts", "r.lesson")


def lesson_digest(lessons: DataFrame, n: int = RECENT_LESSONS) -> DataFrame:
    """The last n lessons as one numbered line."""
    numbered = recent_lessons(lessons, n).withColumn(
        "item", F.format_string(DIGEST_ITEM, "position", "lesson"))
    items = F.sort_array(F.collect_list(F.struct("position", "item")))
    return numbered.agg(F.array_join(F.transform(items, lambda r: r["item"]), "; ").alias("digest"))


def term_overlap(query: Column, text: Column) -> Column:
    """Number of distinct longer query words that occur anywhere in the text."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\w+"), F.lit(0)),
                                      lambda w: F.length(w) >= MIN_TERM_CHARS))
    # the text is bound once, not lowered again for every word
    hits = F.transform(F.array(F.lower(text)), lambda t: F.size(F.filter(found, lambda w: F.contains(t, w))))
    return F.get(hits, F.lit(0)).cast("bigint")


def search_lessons(lessons: DataFrame, query: str, n: int = FOUND_LESSONS) -> DataFrame:
    """The n lessons sharing most words with a query, older ones first among equals."""
    hay = F.concat(F.col("lesson"), F.lit(" "), F.coalesce("question", F.lit("")))
    scored = lessons.withColumn("overlap", term_overlap(F.lit(query), hay)).where("overlap > 0")
    return scored.orderBy(F.desc("overlap"), F.asc("ts"), F.asc("lesson_id")).limit(n)


def new_lessons(critiques: DataFrame) -> DataFrame:
    """Lessons to append from critiques: the question is cut, blank lessons are left out."""
    return critiques.where(F.trim("lesson") != "").select(
        F.trim("lesson").alias("lesson"), F.substring("question", 1, QUESTION_CHARS).alias("question"), "rating")


# --- overview -----------------------------------------------------------------------------------------------------

def estate_overview(**stores: DataFrame) -> DataFrame:
    """(store, n) with the number of rows of every store."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
                                          for name, df in stores.items()])
