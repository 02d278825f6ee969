"""The one-table job: profile, repair, score, with a changelog; and its trust-routed loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import order_stats
from ..operators import profile as pf
from ..operators import repair as rp
from ..operators import score as sc
from ..session import materialize, spread

# --- fixed values: thresholds that decide the results --------------------------------------------
NUMERIC_SHARE = 0.6
TARGET_SCORE = 95.0
MAX_IMPUTED_SHARE = 0.10
SENTENCES = {
    "trimmed": "Trimmed whitespace from {n} cells across all text columns.",
    "deduplicated": "Dropped {n} exact duplicate rows.",
    "date": "Standardised {n} '{column}' values to ISO dates.",
    "currency": "Coerced '{column}' from currency text to numeric.",
    "percent": "Coerced '{column}' from percent text to numeric.",
    "comma_number": "Coerced '{column}' from comma-number text to numeric.",
    "canonicalised": "Canonicalised {n} inconsistent variant(s) in '{column}'.",
    "imputed": "Imputed {n} missing values (numeric→median, text→'UNKNOWN') — disclosed, not silent.",
}
PASS_PREFIX = "[pass {attempt}, {strategy}] "
QUARANTINED = "[escalation] Quarantined {n} unrecoverable row(s) for human review."
NOTHING_QUARANTINED = "[escalation] No unrecoverable rows found to quarantine."
# ---------------------------------------------------------------------------------------------------


@dataclass
class Repair:
    """A repaired table with what was done to it, as (step, column, action, n_changed) rows.

    ``recovered`` is the table before anything was invented: its missing cells are still missing.
    """

    table: DataFrame
    recovered: DataFrame
    profile: pf.TableProfile
    steps: list[tuple[int, str, str, int]] = field(default_factory=list)
    n_imputed: int = 0

    @property
    def changelog(self) -> list[str]:
        return [SENTENCES[action].format(column=column, n=n) for _, column, action, n in self.steps]


def repair(df: DataFrame, profile: pf.TableProfile | None = None, final_dedupe: bool = False) -> Repair:
    """Trim, drop copies, coerce kinds, unify spellings and fill what is missing, in that order.

    The one shuffle that moves whole rows is the one that drops copies; its result, already coerced
    and unified, is written once.  Rows, rewritten dates and missing cells are counted as it is written,
    medians then read only the columns they use, and filling is a projection over those files.
    """
    profile = profile or pf.profile_table(df)
    dates = [c for c, kind in profile.kinds.items() if kind == "date"]
    unique = rp.drop_copies(rp.trim_text(df))
    # each date is read once: for the column itself and for the mark of what was rewritten
    read = unique.select("*", *[tx.to_iso(pf.quoted(c)).alias(f"__iso_{i}") for i, c in enumerate(dates)])
    marks = [(~pf.quoted(c).eqNullSafe(F.col(f"__iso_{i}"))).alias(f"__rewritten_{i}") for i, c in enumerate(dates)]
    dated = read.select(
        *[F.col(f"__iso_{dates.index(c)}").alias(c) if c in dates else pf.quoted(c) for c in df.columns], *marks)
    spellings = {c: m for c, m in profile.trimmed_spellings.items() if c not in profile.kinds}
    fixed = rp.apply_spellings(rp.coerce_kinds(dated, {c: k for c, k in profile.kinds.items() if k != "date"}), spellings)
    watch = Observation()
    counted = fixed.observe(watch, F.count(F.lit(1)).alias("rows"),
                            *[tx.count_where(F.col(f"__rewritten_{i}")).alias(f"rewritten_{i}") for i in range(len(dates))])
    watched, holes = pf.watch_columns(counted, df.columns, _hole_counts(fixed))
    recovered = materialize(watched, "recovered").select(*[pf.quoted(c) for c in df.columns])
    counts = watch.get

    done = Repair(recovered, recovered, profile)
    _log(done, 1, "", "trimmed", sum(profile.trimmed.values()))
    _log(done, 2, "", "deduplicated", profile.n_rows - counts["rows"])
    rewritten = {c: counts[f"rewritten_{i}"] for i, c in enumerate(dates)}
    for c, kind in profile.kinds.items():
        if kind == "date":
            _log(done, 3, c, "date", rewritten[c])
        else:
            done.steps.append((3, c, kind, counts["rows"]))
    for c, mapping in spellings.items():
        _log(done, 4, c, "canonicalised", len(mapping))
    done.table, done.n_imputed = impute(recovered, counts["rows"], holes())
    _log(done, 5, "", "imputed", done.n_imputed)
    if final_dedupe:
        done.table = rp.drop_copies(done.table)
    return done


def _log(done: Repair, step: int, column: str, action: str, n: int) -> None:
    if n:
        done.steps.append((step, column, action, n))


def _hole_counts(df: DataFrame):
    """Measures of a column that say how it is filled."""
    return lambda name, c: {"missing": tx.count_where(pf.missing_word(df, name)), "numeric": F.count(rp.as_number(df, name))}


def impute(df: DataFrame, n_rows: int, measured: dict[str, dict[str, int]] | None = None) -> tuple[DataFrame, int]:
    """Fill missing cells: exact median where most of a column is numeric, else the placeholder.

    ``measured`` are the counts of missing and numeric cells of each column, where they are known already.
    """
    measured = measured or pf.aggregate_columns(df, df.columns, _hole_counts(df))
    holes = {c: m for c, m in measured.items() if m["missing"]}
    numeric = {c: m["numeric"] for c, m in holes.items() if m["numeric"] / n_rows > NUMERIC_SHARE}
    numbers = df.select(*[rp.as_number(df, c).alias(c) for c in numeric])
    medians = order_stats.exact_medians(numbers, numeric)
    all_numeric = {c for c, n in numeric.items() if n + holes[c]["missing"] == n_rows}
    placeholders = [c for c in holes if c not in numeric]
    return rp.fill_missing(df, medians, placeholders, all_numeric), sum(m["missing"] for m in holes.values())


def score(df: DataFrame, profile: pf.TableProfile) -> dict[str, float]:
    """The four dimensions and their mean.

    Missing cells and copies are known from the profile; only the kind columns are read again, to
    count the cells that already are in clean form.
    """
    checked, valid = df.agg(*sc.valid_counts(profile.kinds)).first() if profile.kinds else (0, 0)
    rows, cells = max(profile.n_rows, 1), max(profile.n_rows * len(profile.columns), 1)
    parts = {"completeness": 100.0 * (cells - profile.n_missing) / cells,
             "uniqueness": 100.0 * (rows - profile.n_duplicates) / rows,
             "validity": 100.0 * valid / checked if checked else 100.0,
             "consistency": 0.0 if profile.spellings else 100.0}
    return {**parts, "overall": sum(parts.values()) / len(parts)}


def rescore(df: DataFrame) -> dict[str, float]:
    """Score a repaired table on what a fresh look finds in it."""
    return score(df, pf.profile_table(df))


@dataclass
class LoopReport:
    table: DataFrame
    profile: pf.TableProfile
    before: dict[str, float]
    after: dict[str, float]
    changelog: list[str]
    steps: list[tuple[int, str, str, int]] = field(default_factory=list)
    history: list[dict[str, object]] = field(default_factory=list)
    quarantine: DataFrame | None = None
    n_quarantined: int = 0
    escalated: bool = False


def stage(df: DataFrame) -> DataFrame:
    """The input as it is where its files are columnar; text files are parsed once into the shared folder.

    Every pass over columnar files reads only the columns it uses, so a copy would save nothing.
    """
    texts = any(path.lower().rsplit("?", 1)[0].endswith((".csv", ".gz", ".json", ".txt")) for path in df.inputFiles())
    return materialize(spread(df), "input") if texts else df


def run_once(df: DataFrame) -> LoopReport:
    """Profile, score, repair and score again."""
    df = stage(df)
    profile = pf.profile_table(df)
    fixed = repair(df, profile)
    return LoopReport(fixed.table, profile, score(df, profile), rescore(fixed.table), fixed.changelog, fixed.steps)


def run_trusted(df: DataFrame, mode: str = "mask") -> LoopReport:
    """Repair, and escalate when the score is poor or rests on invented values.

    Escalation sets aside the rows that could not be recovered and repairs the rest once more.
    ``mode="mask"`` sets aside every row that had a missing cell, as it was recovered and without
    invented values; ``mode="reference"`` those in which the placeholder word stands, whether it was
    put there or was in the data.  ``imputed_share`` in the history is measured on what a pass reads,
    so a second pass over invented values reports none.
    """
    if mode not in ("mask", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    df = stage(df)
    profile = pf.profile_table(df)
    share = profile.hole_share
    fixed = repair(df, profile)
    after = rescore(fixed.table)
    report = LoopReport(fixed.table, profile, score(df, profile), after,
                        _prefixed(1, "conservative", fixed), fixed.steps,
                        [_pass(1, "conservative", after, share)])
    if after["overall"] >= TARGET_SCORE and share <= MAX_IMPUTED_SHARE:
        return report

    report.escalated = True
    source = fixed.table if mode == "reference" else fixed.recovered
    bad = rp.any_unknown(source) if mode == "reference" else rp.any_missing(source)
    kept, report.quarantine = rp.split_rows(source, bad)
    report.n_quarantined = report.quarantine.count()
    report.changelog.append(QUARANTINED.format(n=report.n_quarantined) if report.n_quarantined else NOTHING_QUARANTINED)
    second_profile = pf.profile_table(kept)
    share = second_profile.hole_share
    second = repair(kept, second_profile)
    report.table, report.after = second.table, rescore(second.table)
    report.changelog += _prefixed(2, "aggressive", second)
    report.history.append(_pass(2, "aggressive", report.after, share))
    return report


def _prefixed(attempt: int, strategy: str, done: Repair) -> list[str]:
    return [PASS_PREFIX.format(attempt=attempt, strategy=strategy) + line for line in done.changelog]


def _pass(attempt: int, strategy: str, scores: dict[str, float], share: float) -> dict[str, object]:
    return {"attempt": attempt, "strategy": strategy, "score": scores["overall"], "imputed_share": share}
