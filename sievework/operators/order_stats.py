"""Exact order statistics without gathering a column anywhere.

A rank is cornered between two values of the column: a bounded quantile sketch proposes a narrow
pair, one aggregate counts exactly what lies below, on and between them, and the search goes on in
the open interval that holds the rank.  Each pass is one scan with map-side partial results; the
interval shrinks more than a thousandfold per pass, however often single values repeat.  Only when
it holds few rows are its distinct values read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
FEW_ROWS = 50_000


@dataclass
class _Search:
    """One wanted rank (from 0) of one column; the value lies strictly between low and high."""

    column: str
    rank: int
    below: int          # rows at or under `low`, all ranked before the interval
    inside: int         # rows strictly between the bounds
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self, c: Column) -> Column:
        inside = c.isNotNull()
        if self.low is not None:
            inside = inside & (c > self.low)
        if self.high is not None:
            inside = inside & (c < self.high)
        return inside


def exact_ranks(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int],
                few_rows: int = FEW_ROWS, accuracy: int = SKETCH_ACCURACY) -> dict[tuple[str, int], float]:
    """Values at the given ranks (from 0) among the non-null values of numeric columns.

    ``counts`` holds the number of non-null values per column.
    """
    searches = [_Search(c, r, 0, counts[c]) for c, rs in ranks.items() for r in sorted(set(rs))]
    while open_ := [s for s in searches if s.value is None and s.inside > few_rows]:
        _narrow(df, open_, accuracy)
    _finish(df, [s for s in searches if s.value is None])
    return {(s.column, s.rank): s.value for s in searches}


def _narrow(df: DataFrame, searches: list[_Search], accuracy: int) -> None:
    # searches in the same interval share one sketch
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.column, s.low, s.high), []).append(s)
    sketches = []
    for i, group in enumerate(shared.values()):
        c, slack = F.col(f"`{group[0].column}`"), 2.0 / accuracy
        places = [(s.rank - s.below + 0.5) / s.inside for s in group]
        wanted = [min(1.0, max(0.0, p + d)) for p in places for d in (-slack, slack)]
        sketches.append(F.percentile_approx(F.when(group[0].within(c), c), wanted, accuracy).alias(f"q{i}"))
    found = df.agg(*sketches).first()
    bounds = {id(s): found[i][2 * j:2 * j + 2] for i, group in enumerate(shared.values()) for j, s in enumerate(group)}
    guesses = [bounds[id(s)] for s in searches]
    tallies = []
    for i, s in enumerate(searches):
        c, (lo, hi) = F.col(f"`{s.column}`"), guesses[i]
        inside = s.within(c)
        tallies += [F.count_if(inside & (c < lo)), F.count_if(inside & (c == lo)),
                    F.count_if(inside & (c > lo) & (c < hi)), F.count_if(inside & (c == hi))]
    counted = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tallies)]).first()
    for i, s in enumerate(searches):
        (lo, hi), (under, at_lo, between, at_hi) = guesses[i], counted[4 * i:4 * i + 4]
        place = s.rank - s.below
        if place < under:
            s.high, s.inside = lo, under
        elif place < under + at_lo:
            s.value = lo
        elif place < under + at_lo + between:
            s.below, s.low, s.high, s.inside = s.below + under + at_lo, lo, hi, between
        elif hi != lo and place < under + at_lo + between + at_hi:
            s.value = hi
        else:
            gone = under + at_lo + between + (at_hi if hi != lo else 0)
            s.below, s.low, s.inside = s.below + gone, hi, s.inside - gone


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Read the values of the remaining intervals: at most FEW_ROWS rows each."""
    parts = [F.when(s.within(F.col(f"`{s.column}`")),
                    F.struct(F.lit(i).alias("search"), F.col(f"`{s.column}`").cast("double").alias("value")))
             for i, s in enumerate(searches)]
    if not parts:
        return
    hits = df.select(F.explode(F.array_compact(F.array(*parts))).alias("hit"))
    counted = hits.groupBy("hit.search", "hit.value").count().orderBy("search", "value")
    seen: dict[int, int] = {}
    for row in counted.collect():
        s, before = searches[row["search"]], seen.get(row["search"], 0)
        seen[row["search"]] = before + row["count"]
        if s.value is None and before <= s.rank - s.below < seen[row["search"]]:
            s.value = row["value"]


def exact_medians(df: DataFrame, counts: dict[str, int], **limits: int) -> dict[str, float]:
    """Exact median per numeric column: the mean of the two middle values when their number is even."""
    counts = {c: n for c, n in counts.items() if n}
    middles = {c: [(n - 1) // 2, n // 2] for c, n in counts.items()}
    found = exact_ranks(df, middles, counts, **limits)
    return {c: (found[c, lo] + found[c, hi]) / 2 for c, (lo, hi) in middles.items()}
