"""Joins of a wide table with a narrow side that is sent to all tasks only after its rows have been counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow side, and numbers in their arrays, up to which it goes to all tasks; some 50 MB there.
SENT_ROWS, SENT_NUMBERS = 1_000_000, 4_000_000


def narrow(side: DataFrame, numbers: Column | None = None) -> DataFrame:
    """``side``, a written table, marked for broadcast if it is within the bounds; larger ones are shuffled like any other.

    ``numbers`` is the length of the arrays of a row, if it has any; other columns are single numbers.
    """
    rows, held = side.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if numbers is None else numbers), F.lit(0))).first()
    return F.broadcast(side) if rows <= SENT_ROWS and held <= SENT_NUMBERS else side
