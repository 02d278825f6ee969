"""Hits and misses of a cache whose entries live a fixed time from the miss that made them.

The first request of a key is a miss and opens a window; requests at most ``ttl`` seconds later are
hits and do not lengthen it; the first request after that is a miss again.

In batch, a key may hold a large part of all requests, so its timeline is cut into segments that are
worked on independently: whatever window is still open when a segment begins, the segment's misses
follow from where its first miss falls.  Each segment reports, for every possible first miss, when
the last window it leads to ends; chaining these small reports gives each segment its true start.
A segment is never shorter than one lifetime, so a task may hold a lifetime's worth of a key's
requests.  The reports of a key are chained in one task; they are short where different starts soon
lead to the same windows, and grow with the requests of a key so dense that they never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import materialize

# --- fixed values ------------------------------------------------------------------------------------
TTL_SECONDS = 3600
# -------------------------------------------------------------------------------------------------------

SEGMENT_ROWS = 200_000  # distinct request times of a key worked on in one piece
_NONE = np.iinfo("int64").min


def _next_starts(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each time, the position of the first time later than its window."""
    return np.searchsorted(times, times + ttl, side="right")


def _window_ends(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each time taken as a miss, the end of the last window opened in the segment."""
    last = np.arange(len(times))
    jump = np.append(_next_starts(times, ttl), len(times))
    while True:
        onward = jump[last]
        moved = onward < len(times)
        if not moved.any():
            return times[last] + ttl
        last = np.where(moved, np.minimum(onward, len(times) - 1), last)


def _report(times: pd.Series, start: int, ttl: int) -> pd.DataFrame:
    """(first_miss, ends) for the first misses a window left open before the segment can lead to."""
    t = np.unique(times.to_numpy())
    candidates = t[:np.searchsorted(t, start + ttl, side="right") + 1]
    ends = _window_ends(t, ttl)[:len(candidates)]
    last_of_run = np.append(ends[1:] != ends[:-1], True) if len(ends) else np.array([], dtype=bool)
    return pd.DataFrame({"first_miss": candidates[last_of_run], "ends": ends[last_of_run]})


def _misses(times: np.ndarray, open_until: int, ttl: int) -> np.ndarray:
    """Times of the misses among sorted distinct times, given a window open until then (inclusive)."""
    found, at = [], int(np.searchsorted(times, open_until, side="right")) if open_until != _NONE else 0
    following = _next_starts(times, ttl)
    while at < len(times):
        found.append(times[at])
        at = following[at]
    return np.array(found, dtype="int64")


def _segments(times: DataFrame, ttl_us: int, rows: int) -> DataFrame:
    """(request_key, first_us, width_us): a cold key is one segment, a hot one as many as it needs.

    A segment is at least one lifetime long.
    """
    spans = times.groupBy("request_key").agg(F.count(F.lit(1)).alias("n"), F.min("micros").alias("first_us"),
                                             F.max("micros").alias("last_us"))
    width = F.ceil((F.col("last_us") - F.col("first_us") + 1) / F.ceil(F.col("n") / rows))
    return spans.select("request_key", "first_us", F.greatest(width, F.lit(ttl_us)).cast("bigint").alias("width_us"))


def classify(requests: DataFrame, ttl: int = TTL_SECONDS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``is_miss`` to requests (event_id, request_key, micros), ordered by (micros, event_id)."""
    ttl_us = ttl * 1_000_000
    key_type = requests.schema["request_key"].dataType.simpleString()

    # Equal times of a key collapse in each task: the timeline needs every time once, with the id of
    # its first request.
    firsts = requests.groupBy("request_key", "micros").agg(F.min("event_id").alias("event_id"))
    segments = _segments(firsts, ttl_us, segment_rows)
    number = F.floor((F.col("micros") - F.col("first_us")) / F.col("width_us")).cast("bigint")
    times = materialize(
        firsts.join(segments, "request_key").withColumn("segment", number)
        .withColumn("start_us", F.col("first_us") + F.col("segment") * F.col("width_us"))
        .select("request_key", "segment", "start_us", "micros", "event_id"), "request-times")

    def report(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _report(rows["micros"], int(rows["start_us"].iloc[0]), ttl_us)
        return found.assign(request_key=keys[0], segment=keys[1])

    reports = times.groupBy("request_key", "segment").applyInPandas(
        report, f"first_miss bigint, ends bigint, request_key {key_type}, segment bigint")

    def chain(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        open_until, out = _NONE, []
        for number, part in rows.sort_values(["segment", "first_miss"]).groupby("segment", sort=True):
            out.append((keys[0], number, open_until))
            later = part[part["first_miss"] > open_until]
            if len(later):
                open_until = int(later["ends"].iloc[0])
        return pd.DataFrame(out, columns=["request_key", "segment", "open_until"])

    starts = reports.groupBy("request_key").applyInPandas(
        chain, f"request_key {key_type}, segment bigint, open_until bigint")

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("micros")
        missed = _misses(rows["micros"].to_numpy(), int(rows["open_until"].iloc[0]), ttl_us)
        return rows.loc[rows["micros"].isin(missed), ["event_id"]].assign(missed=True)

    known = times.join(starts, ["request_key", "segment"])
    id_type = requests.schema["event_id"].dataType.simpleString()
    misses = known.groupBy("request_key", "segment").applyInPandas(resolve, f"event_id {id_type}, missed boolean")
    return (requests.join(misses, "event_id", "left").withColumn("is_miss", F.col("missed").isNotNull())
            .drop("missed"))


def classify_stream(requests: DataFrame, ttl: int = TTL_SECONDS, late: str = "2 hours") -> DataFrame:
    """The same over a stream of (event_id, request_key, ts): (event_id, request_key, is_miss).

    State is the opening time of the key's window; an event-time timer drops it once the watermark
    has passed the window's end.  Within a batch the requests of a key are taken in time order.
    """
    ttl_us = ttl * 1_000_000
    id_type = requests.schema["event_id"].dataType.simpleString()
    key_type = requests.schema["request_key"].dataType.simpleString()

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        micros = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        opened = state.get[0] if state.exists else _NONE
        t = np.unique(micros)
        missed = _misses(t, opened + ttl_us if opened != _NONE else _NONE, ttl_us)
        is_miss = np.isin(micros, missed) & np.append(True, micros[1:] != micros[:-1])
        if len(missed):
            opened = int(missed[-1])
        state.update((opened,))
        state.setTimeoutTimestamp(max((opened + ttl_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "request_key": keys[0], "is_miss": is_miss})

    return (requests.withWatermark("ts", late).groupBy("request_key")
            .applyInPandasWithState(step, f"event_id {id_type}, request_key {key_type}, is_miss boolean",
                                    "opened bigint", "append", GroupStateTimeout.EventTimeTimeout))
