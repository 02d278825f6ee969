"""Usage, evaluation, notes and lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..operators import accounting as ac
from ..plans import reports
from ..registry import operation
from ..sources.tables import fixture, table

# An example price list; it covers some of the models, the others get the default price.
PRICES = [("model-click", 0.8, 4.0), ("model-view", 1.5, 6.0), ("model-error", 3.0, 15.0)]
_PRICES_SQL = "pricing(model, input_price, output_price) AS (VALUES " + ", ".join(
    f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in PRICES) + ")"


def _pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


_PER_MODEL = """m AS (SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write FROM usage_log GROUP BY model)"""


@operation("AGG-20", uses=["usage_log"], sql=f"""+ {_PER_MODEL}
SELECT model, calls, input_tokens, output_tokens, CAST(NULL AS BIGINT) AS cache_read, CAST(NULL AS BIGINT) AS cache_write FROM m
UNION ALL SELECT '(all)', CAST(sum(calls) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT),
  CAST(sum(cache_read) AS BIGINT), CAST(sum(cache_write) AS BIGINT) FROM m""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and tokens per model and in total."""
    return ac.usage_totals(fixture(spark, sf, "usage_log"))


_COSTS = f"""{_PER_MODEL}, {_PRICES_SQL},
c AS (SELECT m.model, calls, input_tokens / 1e6 * coalesce(input_price, 3.0) + output_tokens / 1e6 * coalesce(output_price, 15.0)
  AS cost_usd FROM m LEFT JOIN pricing ON m.model = pricing.model)"""


@operation("AGG-21 JOIN-6", uses=["usage_log"], sql=f"""+ {_COSTS}
SELECT model, calls, round(cost_usd, 4) AS cost_usd FROM c""")
def model_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost per model, the default price where none is listed."""
    return ac.model_costs(fixture(spark, sf, "usage_log"), _pricing(spark)).withColumn("cost_usd", F.round("cost_usd", 4))


@operation("AGG-22 AGG-21", uses=["usage_log"], sql=f"""+ {_COSTS}
SELECT model, calls, round(cost_usd, 4) AS cost_usd FROM c
UNION ALL SELECT '(all)', CAST(sum(calls) AS BIGINT), round(sum(cost_usd), 4) FROM c""")
def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cost and calls per model and in total."""
    return ac.cost_summary(fixture(spark, sf, "usage_log"), _pricing(spark))


@operation("AGG-25", uses=["usage_log"], sql="""
SELECT conv_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens FROM usage_log GROUP BY conv_id""")
def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token totals per conversation."""
    return ac.conversation_tokens(fixture(spark, sf, "usage_log"))


@operation("JOB-8 AGG-20", uses=["usage_log"], sql=f"""+ {_COSTS}
SELECT c.model, format('{{}}: {{:,}} calls | {{:,}} in / {{:,}} out | ~${{:.4f}}', c.model, c.calls, input_tokens, output_tokens,
  cost_usd) AS line FROM c JOIN m ON c.model = m.model""")
def usage_text(spark: SparkSession, sf: str) -> DataFrame:
    """Usage per model as text lines."""
    usage = fixture(spark, sf, "usage_log")
    return reports.usage_lines(ac.usage_totals(usage), ac.model_costs(usage, _pricing(spark)))


@operation("JOB-8 AGG-20 AGG-22", uses=["usage_log"], sql=f"""+ {_COSTS},
t AS (SELECT sum(calls) AS calls, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read) AS r, sum(cache_write) AS w,
  (SELECT max(ts) FROM usage_log) AS last FROM m)
SELECT 1 AS section, '' AS model, format('Total chat calls : {{:,}}', CAST(calls AS BIGINT)) AS line FROM t
UNION ALL SELECT 2, '', format('Total input tokens : {{:,}}', CAST(i AS BIGINT)) FROM t
UNION ALL SELECT 3, '', format('Total output tokens : {{:,}}', CAST(o AS BIGINT)) FROM t
UNION ALL SELECT 4, '', format('Cache read tokens : {{:,}}', CAST(r AS BIGINT)) FROM t
UNION ALL SELECT 5, '', format('Cache write tokens : {{:,}}', CAST(w AS BIGINT)) FROM t
UNION ALL SELECT 6, '', 'By model:'
UNION ALL SELECT 7, c.model, format('{{}}: {{:,}} calls | {{:,}} in / {{:,}} out | ~${{:.4f}}', c.model, c.calls, input_tokens,
  output_tokens, cost_usd) FROM c JOIN m ON c.model = m.model
UNION ALL SELECT 8, '', format('Estimated total cost : ~${{:.4f}} USD', sum(cost_usd)) FROM c
UNION ALL SELECT 9, '', 'Last updated : ' || strftime(last, '%Y-%m-%d %H:%M:%S') FROM t""")
def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, lines per model, cost and time of the last call as one block of text lines."""
    return reports.usage_report(fixture(spark, sf, "usage_log"), _pricing(spark))


@operation("AGG-23", uses=["eval_scores"], sql="""
SELECT metric, round(avg(score), 6) AS mean, count(score) AS n_scored FROM eval_scores GROUP BY metric""")
def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean per metric over the scores that are there."""
    return ac.metric_means(fixture(spark, sf, "eval_scores")).withColumn("mean", F.round("mean", 6))


_METRICS = ["faithfulness", "relevance", "conciseness"]


@operation("AGG-23", uses=["eval_scores"], sql="SELECT example_id, " + ", ".join(
    f"max(score) FILTER (WHERE metric = '{m}') AS {m}" for m in _METRICS) + " FROM eval_scores GROUP BY example_id")
def scores_per_example(spark: SparkSession, sf: str) -> DataFrame:
    """One row per example with a column per metric."""
    return ac.scores_per_example(fixture(spark, sf, "eval_scores"), _METRICS)


@operation("AGG-24", uses=["eval_scores"], sql="""
SELECT example_id, metric AS gate, score FROM eval_scores
WHERE metric IN ('faithfulness', 'relevance') AND coalesce(score, 0) < 0.7""")
def gate_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Examples that fail a gated metric; an absent score counts as zero."""
    return ac.gate_failures(fixture(spark, sf, "eval_scores"))


@operation("AGG-24", uses=["eval_scores"], sql="""
SELECT count(DISTINCT example_id) AS n_examples, count(*) FILTER (WHERE metric IN ('faithfulness', 'relevance')
  AND coalesce(score, 0) < 0.7) AS n_failures, count(*) FILTER (WHERE metric IN ('faithfulness', 'relevance')
  AND coalesce(score, 0) < 0.7) = 0 AS passed FROM eval_scores""")
def gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the evaluation run passed."""
    return ac.gate_summary(fixture(spark, sf, "eval_scores"))


@operation("AGG-24", uses=["eval_scores"], sql="""
SELECT example_id, metric AS gate, substr(text, 1, 48) || ' — ' || metric || '=' || coalesce(CAST(score AS varchar), 'None')
  AS line FROM eval_scores JOIN documents ON doc_id = example_id
WHERE metric IN ('faithfulness', 'relevance') AND coalesce(score, 0) < 0.7""")
def gate_failure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Failing examples as text lines."""
    questions = table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("question"))
    return ac.failure_lines(ac.gate_failures(fixture(spark, sf, "eval_scores")), questions)


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"),
                                             F.col("props").alias("value"), F.col("ts").alias("updated_at"),
                                             F.col("event_id").alias("seq"))


@operation("WIN-1", sql="""
SELECT key, value, CAST(epoch_us(ts) AS BIGINT) AS updated_us FROM (SELECT event_type || '-' || CAST(user_id AS varchar) AS key, props AS value, ts,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Latest value of every note."""
    notes = ac.notes_listing(_notes(spark, sf))
    return notes.select("key", "value", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@operation("WIN-2", uses=["lessons"], sql="""
SELECT row_number() OVER (ORDER BY ts, lesson_id) AS position, lesson_id, lesson FROM
  (SELECT * FROM lessons ORDER BY ts DESC, lesson_id DESC LIMIT 12)""")
def recent_lessons(spark: SparkSession, sf: str) -> DataFrame:
    """The last twelve lessons in order."""
    return ac.recent_lessons(fixture(spark, sf, "lessons")).drop("ts")


@operation("WIN-2", uses=["lessons"], sql="""
SELECT string_agg('(' || CAST(position AS varchar) || ') ' || lesson, '; ' ORDER BY position) AS digest FROM
(SELECT row_number() OVER (ORDER BY ts, lesson_id) AS position, lesson FROM
  (SELECT * FROM lessons ORDER BY ts DESC, lesson_id DESC LIMIT 12))""")
def lesson_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The last twelve lessons as one line."""
    return ac.lesson_digest(fixture(spark, sf, "lessons"))


_QUERY = "Which purchase checks were preferred over other user checks in signup flows?"
_TERMS = ["which", "purchase", "checks", "were", "preferred", "over", "other", "user", "signup", "flows"]
_OVERLAP = " + ".join(f"CAST(contains(lower(lesson || ' ' || question), '{t}') AS BIGINT)" for t in _TERMS)


@operation("SRT-3", uses=["lessons"], sql=f"""
SELECT lesson_id, lesson, overlap FROM (SELECT *, {_OVERLAP} AS overlap FROM lessons) WHERE overlap > 0
ORDER BY overlap DESC, ts, lesson_id LIMIT 5""")
def lesson_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five lessons sharing most words with a question."""
    return ac.search_lessons(fixture(spark, sf, "lessons"), _QUERY).select("lesson_id", "lesson", "overlap")


@operation("TXT-6", uses=["lessons"], sql=f"SELECT lesson_id, {_OVERLAP} AS overlap FROM lessons")
def lesson_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Number of question words found in every lesson."""
    hay = F.concat("lesson", F.lit(" "), "question")
    return fixture(spark, sf, "lessons").select("lesson_id", ac.term_overlap(F.lit(_QUERY), hay).alias("overlap"))


@operation("AGG-26", uses=["usage_log", "lessons"], sql="""
SELECT 'notes' AS store, count(DISTINCT event_type || '-' || CAST(user_id AS varchar)) AS n FROM events
UNION ALL SELECT 'passages', count(*) FROM documents UNION ALL SELECT 'lessons', count(*) FROM lessons
UNION ALL SELECT 'usage', count(*) FROM usage_log""")
def estate_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Number of rows in every store."""
    return ac.estate_overview(notes=ac.latest_notes(_notes(spark, sf)), passages=table(spark, sf, "documents"),
                              lessons=fixture(spark, sf, "lessons"), usage=fixture(spark, sf, "usage_log"))


@operation("STR-4 WIN-1", uses=["requests"], sql="""
SELECT event_id, sha256('{"request_key":"' || request_key || '"}') AS content_hash FROM requests""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of the canonical JSON of every request."""
    return fixture(spark, sf, "requests").select("event_id", pl.content_hash(F.col("request_key")).alias("content_hash"))
