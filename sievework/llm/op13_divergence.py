"""How the words of a source differ from those of the other sources and of its whole language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language keeps the terms that occur in at
least ``least_docs`` of its documents.  The share of a term in a group is ``p = 1 + floor(10^9 (count + 1) / (N + V))`` and
the divergence of p from q is ``floor((p - q)^2 / q)``, all in exact integers.

Nothing is worked out term by term.  Terms of a group with equal (group count, language count) form a cell, the
divergence is evaluated once a cell, cells of equal value are merged, and values are ranked by the cumulative number
of their terms.  Only cells that reach the wanted ranks are expanded again to terms, in UTF-8 order.  Two sources are
compared by cells of (count, count): terms that one of them lacks come from each source's own histogram of counts,
terms that both lack are one cell, and only terms that both have are counted together.

Null text, language and source are read as ''.  A source without terms counts every kept term zero times; a language that
keeps no term has value 0 for each pair and no term rows.  Repeated rows count each.  Texts of any length are read
whole.  Equal values rank by item, in UTF-8 order.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sides import narrow

#: What stands between terms, the scale of a share.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Counts whose product with the scale is a long integer.
_FITS = 9_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, the term's occurrences there and the number of documents they are in."""
    terms = F.sort_array(F.split(F.translate("text", _UPPER, _LOWER), BETWEEN))
    # in sorted terms the first of equal ones stands for the document; an outer explode evaluates them once
    said = _read(docs).select("lang", "source", terms.alias("terms")).select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term"))
    first = (F.col("at") == 0) | (F.get("terms", F.col("at") - 1) != F.col("term"))
    return said.where("term <> ''").select("lang", "source", "term", F.when(first, 1).otherwise(0).alias("first")).groupBy(
        "lang", "source", "term").agg(F.count("*").alias("count"), F.sum("first").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term, exact for any count: in long integers where the product fits, in decimals beyond."""
    more, whole = count.cast("long") + 1, n + v
    exact = F.call_function("div", more.cast("decimal(28,0)") * F.lit(SCALE), whole.cast("decimal(28,0)"))
    return F.when(count < _FITS, F.call_function("div", more * F.lit(SCALE), whole.cast("long"))).otherwise(exact) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and the divergence from item summed over the kept terms, for all pairs of sources of a language."""
    zero, wide = F.lit(0), "decimal(38,0)"
    a = groups.select("lang", "source", F.col("n").alias("n_a"), "v", F.col("held").alias("held_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("n_b"), F.col("held").alias("held_b"))
    pairs = materialize(a.join(b, "lang").where("source <> item"), "source-pairs")
    some = narrow(pairs.where("v > 0"))
    counts = materialize(kept.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")), "count-histograms")

    def f(ca: Column, cb: Column, n_a: str = "n_a", n_b: str = "n_b") -> Column:
        return divergence(share(ca, F.col(n_a), F.col("v")), share(cb, F.col(n_b), F.col("v")))

    def over(terms: Column, each: Column) -> Column:
        return (terms.cast("decimal(20,0)") * each.cast("decimal(20,0)")).cast(wide)

    key = ["lang", "source", "item"]
    neither = pairs.select(*key, F.when(F.col("v") > 0, over(F.col("v") - F.col("held_a") - F.col("held_b"), f(zero, zero))).otherwise(
        F.lit(0).cast(wide)).alias("value"))
    ca, cb, terms = F.col("ca"), F.col("cb"), F.col("terms")
    of_a = counts.withColumnRenamed("count", "ca").join(some, ["lang", "source"]).select(*key, over(terms, f(ca, zero)).alias("value"))
    of_b = counts.toDF("lang", "item", "cb", "terms").join(some, ["lang", "item"]).select(*key, over(terms, f(zero, cb)).alias("value"))
    # the sources of a term meet in one order, and each cell gives the values of both
    x = kept.select("lang", "term", "source", F.col("count").alias("ca"))
    y = kept.select("lang", "term", F.col("source").alias("item"), F.col("count").alias("cb"))
    cells = x.join(y, ["lang", "term"]).where("source < item").groupBy(*key, "ca", "cb").agg(F.count("*").alias("terms"))
    there = f(ca, cb) - f(ca, zero) - f(zero, cb) + f(zero, zero)
    back = f(cb, ca, "n_b", "n_a") - f(cb, zero, "n_b", "n_a") - f(zero, ca, "n_b", "n_a") + f(zero, zero, "n_b", "n_a")
    summed = cells.join(some, key).select(*key, over(terms, there).alias("there"), over(terms, back).alias("back")).groupBy(*key).agg(
        F.sum("there").alias("there"), F.sum("back").alias("back"))
    both = summed.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")),
                                                  F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    every = neither.unionByName(of_a).unionByName(of_b).unionByName(both)
    return every.groupBy(*key).agg(F.sum("value").cast("long").alias("value"))


def _term_ranks(kept: DataFrame, groups: DataFrame, upto: int) -> DataFrame:
    """lang, source, item, value and rank of the terms a source uses more than its language, up to a rank."""
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "count", "lang_count").agg(F.count("*").alias("terms")).join(narrow(groups), group)
    p = share(F.col("count"), F.col("n"), F.col("v"))
    q = share(F.col("lang_count"), F.col("n_lang"), F.col("v"))
    cells = materialize(cells.select(*group, "count", "lang_count", "terms", p.alias("p"), q.alias("q")).where("p > q").select(
        *group, "count", "lang_count", "terms", divergence(F.col("p"), F.col("q")).alias("value")), "cells")
    # a value stands for one term at least, so values beyond the wanted ranks cannot reach them
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = cells.groupBy(*group, "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(by_value)).where(
        F.col("place") <= upto)
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    reached = merged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < upto).select(*group, "value", "before")
    wanted = materialize(cells.join(reached, [*group, "value"]).drop("terms"), "wanted-cells")
    found = kept.join(narrow(wanted), [*group, "count", "lang_count"]).withColumn(
        "within", F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))).where(F.col("within") <= upto)
    return found.select(*group, F.col("term").alias("item"), "value", (F.col("before") + F.col("within")).cast("int").alias("rank")).where(
        F.col("rank") <= upto)


def audit(docs: DataFrame, least_docs: int = 3, upto: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` compares a source with each other source of its language,
    part ``term`` lists the ``upto`` terms by which it departs most from the language."""
    counts = materialize(term_counts(docs), "term-counts")
    lang_terms = materialize(counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least_docs).drop("docs"), "language-terms")
    kept = materialize(counts.join(lang_terms, ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"), "kept-terms")
    langs = lang_terms.groupBy("lang").agg(F.sum("lang_count").alias("n_lang"), F.count("*").alias("v"))
    held = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held"))
    groups = materialize(_read(docs).select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
                         .na.fill(0, ["n", "held", "n_lang", "v"]), "groups")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_values(kept, groups).withColumn("rank", F.row_number().over(first))
    terms = _term_ranks(kept, groups, upto)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
