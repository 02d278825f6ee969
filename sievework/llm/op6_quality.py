"""Quality rules with robust multivariate outliers.

Every text gives a vector of transformed statistics.  For each language and source the minimum-covariance-determinant
estimate is approached by concentration steps: the three quarters of the documents nearest to the
current centre give the next centre and covariance.  A document is rejected when its squared
Mahalanobis distance exceeds a fixed quantile, or by the base rules.

A step needs no ordering of documents: moments are summed per group and distance bin, and the bins
are taken from the inside out.  A group however large is a few hundred rows by then.  Groups of too few
documents are pooled per language, and if that is too few as well, only the base rules apply.

Null texts and texts without words have no words and fail the base rules.  Rows are judged one by one, repeated rows
alike.  A null language or source is a group of its own.  Clashing extra columns are ignored by
:func:`judged` and kept by :func:`keep_good`.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .native import SEPARATORS, hashed_window, let, upto, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Share of a group that the estimate rests on, and how much smaller its covariance is in four dimensions.
SUBSET = 0.75
SHRINKAGE = 1.485
STEPS = 4
#: 0.9999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.51
#: Spread below which differences of a statistic mean nothing, in the order of FEATURES.  The last two are such that lines
#: that are nearly all copies (at most log 11) and words that just pass the base rules (log 3) exceed CUTOFF by themselves.
FLOORS = [0.3, 0.25, 0.4, 0.22]
FEATURES = ["x0", "x1", "x2", "x3"]
#: Words of five letters that every text is taken to have besides its own, for its mean word length.
PRIOR_WORDS, PRIOR_LETTERS = 50, 5
LEAST_GROUP = 50
_BINS = 400


def _repeated(h: Column) -> Column:
    """Words covered by windows, given by their hashes, that occur twice at least."""
    def covered(at: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(WINDOW)))
        return F.aggregate(upto(F.size(at)), F.lit(0), step)

    def places(s: Column) -> Column:
        here = lambda k: F.get(s, k)["h"]
        same = lambda k: ((k > 0) & (here(F.greatest(k - 1, F.lit(0))) == here(k))) | F.coalesce(here(k + 1) == here(k), F.lit(False))
        return let(F.sort_array(F.transform(F.filter(upto(F.size(s)), same), lambda k: F.get(s, k)["i"])), covered)

    indexed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(indexed), places)).otherwise(F.lit(0))


def _lines(text: Column) -> Column:
    """Number of lines with a word, and how many of them are copies."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda lines: F.struct(
        F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("copies")))


def statistics(text: Column) -> Column:
    """Struct of the base statistics of a text."""
    def of(t: Column) -> Column:
        return let(words(t), lambda w: let(F.translate(t, SEPARATORS, ""), lambda dense: let(_lines(t), lambda lines: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(dense).cast("long").alias("word_chars"),
            (F.length(dense) - F.length(F.translate(dense, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines["copies"].alias("n_dup_lines"), lines["n"].alias("n_lines"),
            let(F.transform(upto(F.size(w) - (WINDOW - 1)), lambda i: hashed_window(w, i, WINDOW)), _repeated)
            .cast("long").alias("n_repeat_words")))))

    return let(F.coalesce(text, F.lit("")), of)


def _with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with columns stats, lang_key and source_key; other columns stay."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) if c in docs.columns else F.lit("")
    return docs.withColumns({"stats_": statistics(F.col("text").cast("string")), "lang_key_": key("lang"), "source_key_": key("source")})


def _vector(df: DataFrame) -> DataFrame:
    s = lambda name: F.col(f"stats_.{name}").cast("double")
    n, chars = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("word_chars"), F.lit(1.0))
    return df.withColumns({
        "failed_": (F.col("stats_.n_words") < LEAST_WORDS)
        | (100 * F.col("stats_.n_repeat_words") > MOST_REPEATED * F.col("stats_.n_words")),
        "x0": F.log1p(100 * s("n_symbols") / chars),
        "x1": (s("word_chars") + PRIOR_WORDS * PRIOR_LETTERS) / (s("n_words") + PRIOR_WORDS),
        "x2": F.log1p(10 * s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1.0))),
        "x3": F.log1p(10 * s("n_repeat_words") / n)})


def _distance(df: DataFrame) -> DataFrame:
    """``df`` with ``d2_``, the squared distance from centre m_i by the lower triangle l_ij."""
    d2 = F.lit(0.0)
    for i, x in enumerate(FEATURES):
        z = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}_")
        df = df.withColumn(f"z{i}_", z / F.col(f"l{i}{i}"))
        d2 = d2 + F.col(f"z{i}_") * F.col(f"z{i}_")
    return df.withColumn("d2_", d2).drop(*(f"z{i}_" for i in range(len(FEATURES))))


def _triangle(moments: DataFrame) -> DataFrame:
    """Cholesky factor of the scaled covariance plus the floors, from sums per group."""
    d = len(FEATURES)
    df = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(d)})
    for i in range(d):
        for j in range(i + 1):
            c = SHRINKAGE * (F.col(f"s{j}{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 4))) if i == j else c / F.col(f"l{j}{j}"))
    return df.select(*(c for c in ("group_", "start") if c in df.columns), *(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1)))


def groups(vectors: DataFrame) -> DataFrame:
    """lang_key_, source_key_ -> group_: the pair, the language for small pairs, null for small languages."""
    sizes = vectors.where("NOT failed_").groupBy("lang_key_", "source_key_").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_GROUP).groupBy("lang_key_").agg(F.sum("n").alias("pooled"))
    return sizes.join(small, "lang_key_", "left").select(
        "lang_key_", "source_key_",
        F.when(F.col("n") >= LEAST_GROUP, F.concat("lang_key_", F.lit("\n"), "source_key_"))
        .when(F.col("pooled") >= LEAST_GROUP, F.col("lang_key_")).alias("group_"))


def fit(vectors: DataFrame) -> DataFrame:
    """Centre and lower triangle of every language and source, after the concentration steps."""
    d = len(FEATURES)
    keys = groups(vectors)
    good = materialize(vectors.where("NOT failed_").join(keys, ["lang_key_", "source_key_"]).where("group_ IS NOT NULL")
                       .select("group_", *FEATURES), "vectors")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)] + [
        F.sum(F.col(FEATURES[j]) * F.col(FEATURES[i])).alias(f"s{j}{i}") for i in range(d) for j in range(i + 1)]
    names = [f"s{i}" for i in range(d)] + [f"s{j}{i}" for i in range(d) for j in range(i + 1)]
    estimate = _starts(good, sums)
    for _ in range(STEPS):
        binned = _distance(good.join(estimate, "group_")).withColumn(
            "bin", F.least(F.lit(_BINS - 1), F.floor(30 * F.log1p("d2_")).cast("int")))
        moments = binned.groupBy("group_", "start", "bin").agg(F.count("*").alias("n"), *sums)
        inside = Window.partitionBy("group_", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        taken = (moments.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
                 .withColumn("all", F.sum("n").over(Window.partitionBy("group_", "start"))).where(F.col("before") < SUBSET * F.col("all")))
        estimate = materialize(_triangle(taken.groupBy("group_", "start").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))),
                               "estimate")
    size = sum(F.log(f"l{i}{i}") for i in range(d))
    best = estimate.groupBy("group_").agg(F.min_by(F.struct(*(c for c in estimate.columns if c not in ("group_", "start"))), F.struct(
        F.round(size, 9), "start")).alias("best"))
    return keys.join(best.select("group_", "best.*"), "group_").drop("group_")


def _starts(good: DataFrame, sums: list[Column]) -> DataFrame:
    """Three first estimates a group: medians with the floors as spread, medians with the spread of the middle half, all rows."""
    d, at = len(FEATURES), F.col
    rows = good.groupBy("group_").agg(F.count("*").alias("n"), *sums, *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}")
                                                                     for i, x in enumerate(FEATURES)))
    quartile = lambda i, k: F.get(at(f"q{i}"), F.lit(k))

    def around(start: int, spread) -> DataFrame:
        return rows.select("group_", F.lit(start).alias("start"), *(F.round(quartile(i, 1), 2).alias(f"m{i}") for i in range(d)), *(
            (spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(d) for j in range(i + 1)))

    return materialize(around(0, lambda i: F.lit(FLOORS[i])).unionByName(
        around(1, lambda i: F.greatest(F.lit(FLOORS[i]), (quartile(i, 2) - quartile(i, 0)) / 1.349))).unionByName(
        _triangle(rows.withColumn("start", F.lit(2)))), "starts")


def _verdict(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    return _distance(vectors.join(estimate, ["lang_key_", "source_key_"], "left")).withColumn(
        "kept_", ~F.col("failed_") & F.coalesce(F.col("d2_") <= CUTOFF, F.lit(True)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance of every row."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in ("lang", "source") if c in docs.columns)]
    table = materialize(_with_statistics(docs.select(*cols)).drop("text", "lang", "source"), "statistics")
    vectors = _vector(table)
    return _verdict(vectors, fit(vectors)).select(
        "doc_id", *(F.col(f"stats_.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("failed_").alias("base_failed"), F.col("kept_").alias("kept"), F.sqrt("d2_").alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    packed = _with_statistics(docs.select(F.struct(*docs.columns).alias("row_"), *(c for c in ("text", "lang", "source") if c in docs.columns)))
    # rows are written with their statistics, which cost far more than the writing and would be worked out again for each use
    table = materialize(packed.select("row_", "stats_", "lang_key_", "source_key_"), "statistics")
    return _verdict(_vector(table), fit(_vector(table.drop("row_")))).where("kept_").select("row_.*")
