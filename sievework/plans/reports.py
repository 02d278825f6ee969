"""Plain-text reports from metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import accounting as ac
from . import single_table as st

# --- fixed values: report lines --------------------------------------------------------------------
SCORE_LINE = "%-16s%8.1f%8.1f"
ROWS_LINE = "  rows: {rows}, columns: {columns}"
TOTAL_LINE = "  score: {before:.1f} -> {after:.1f} (target {target})"
PASSES_LINE = "  passes run: {passes}"
PASS_LINE = "    pass {attempt} ({strategy}): score {score:.1f}, {share:.1f}% of cells imputed"
ESCALATED_LINE = ("  escalated: the first score was inflated by imputation, so {n} unrecoverable row(s) were quarantined "
                  "and the data re-scored.")
EARNED_LINE = "  no escalation needed: the score was earned, not imputed."
USAGE_LINE = "%s: %,d calls | %,d in / %,d out | ~$%.4f"
USAGE_TOTALS = [("Total chat calls : %,d", "calls"), ("Total input tokens : %,d", "input_tokens"),
                ("Total output tokens : %,d", "output_tokens"), ("Cache read tokens : %,d", "cache_read"),
                ("Cache write tokens : %,d", "cache_write")]
MODELS_LINE = "By model:"
TOTAL_COST_LINE = "Estimated total cost : ~$%.4f USD"
UPDATED_LINE = "Last updated : %s"
NO_USAGE_LINE = "No usage data recorded yet."
NEVER, UNNAMED = "never", "(unnamed)"
# -----------------------------------------------------------------------------------------------------


def scorecard_lines(phases: DataFrame, columns: list[str]) -> DataFrame:
    """(position, line) with one line per dimension from a (phase, dimensions...) table of two rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("dimension"), F.col(c).alias("score"))
                      for i, c in enumerate(columns, 1)])
    long = phases.select("phase", F.inline(cells))
    wide = long.groupBy("position", "dimension").agg(
        F.max(F.when(F.col("phase") == "before", F.col("score"))).alias("before"),
        F.max(F.when(F.col("phase") == "after", F.col("score"))).alias("after"))
    return wide.select("position", F.format_string(SCORE_LINE, "dimension", "before", "after").alias("line"))


def loop_lines(name: str, report: st.LoopReport) -> list[str]:
    """Report of a loop run as lines."""
    lines = [f"Quality loop on {name}", ROWS_LINE.format(rows=report.profile.n_rows, columns=len(report.profile.columns)),
             TOTAL_LINE.format(before=report.before["overall"], after=report.after["overall"], target=st.TARGET_SCORE),
             PASSES_LINE.format(passes=len(report.history))]
    lines += [PASS_LINE.format(attempt=h["attempt"], strategy=h["strategy"], score=h["score"],
                               share=100 * h["imputed_share"]) for h in report.history]
    lines.append(ESCALATED_LINE.format(n=report.n_quarantined) if report.escalated else EARNED_LINE)
    return lines + [f"    {line}" for line in report.changelog]


def usage_lines(totals: DataFrame, costs: DataFrame) -> DataFrame:
    """(model, line) of per-model usage with its cost."""
    return totals.join(costs.select("model", "cost_usd"), "model").select(
        "model", F.format_string(USAGE_LINE, "model", "calls", "input_tokens",
                                 "output_tokens", "cost_usd").alias("line"))


def usage_report(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """(section, model, line): the totals, a line a model, the cost and the last call, in the order of section and model.

    The log is read once: totals are a rollup of the sums per model.  Lines of totals have an empty
    model, calls without a model are listed as unnamed, missing tokens count as none, and an empty
    log gives one line that says so, for which a row without calls joins the sums.
    """
    values = [*(c for _, c in USAGE_TOTALS), "cost_usd"]
    models = ac.priced_usage(usage, pricing).withColumn("model", F.coalesce("model", F.lit(UNNAMED)))
    seed = usage.sparkSession.range(1).select(F.lit("").alias("model"), *[F.lit(0).alias(c) for c in values],
                                              F.lit(None).alias("last_call"))
    sums = (models.select(*seed.columns).unionByName(seed).rollup("model")
            .agg(*[F.sum(c).alias(c) for c in values], F.max("last_call").alias("last_call"),
                 (F.grouping("model") == 1).alias("is_total")))
    updated = F.coalesce(F.date_format("last_call", "yyyy-MM-dd HH:mm:ss"), F.lit(NEVER))
    own = len(USAGE_TOTALS) + 2
    block = F.array(*[_line(i, F.format_string(text, c)) for i, (text, c) in enumerate(USAGE_TOTALS, 1)],
                    _line(own - 1, F.lit(MODELS_LINE)), _line(own + 1, F.format_string(TOTAL_COST_LINE, "cost_usd")),
                    _line(own + 2, F.format_string(UPDATED_LINE, updated)))
    per_model = F.array(_line(own, F.format_string(USAGE_LINE, "model", "calls", "input_tokens", "output_tokens", "cost_usd")))
    no_calls = F.col("calls") == 0
    return (sums.where(F.col("is_total") | ~no_calls)
            .select(F.when(F.col("is_total"), F.lit("")).otherwise(F.col("model")).alias("model"),
                    F.inline(F.when(no_calls, F.array(_line(1, F.lit(NO_USAGE_LINE))))
                             .when(F.col("is_total"), block).otherwise(per_model)))
            .select("section", "model", "line"))


def _line(section: int, text: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), text.alias("line"))
