"""Incremental scoring: an extension for tables that arrive as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phenoframe.functions.dates import shift
from phenoframe.operators.codes import any_pattern


def notes_with_codes(notes: DataFrame, events: DataFrame, tests: dict[str, Column], back: str, ahead: str) -> DataFrame:
    """A stream of notes (id, date, ...) joined with a table of events: each pair in the window with the tests' 0/1 flags. No state is kept."""
    e = events.withColumnRenamed("date", "_at").withColumnRenamed("id", "_key")
    near = (F.col("id") == F.col("_key")) & F.col("date").between(shift("_at", f"-{back}"), shift("_at", ahead))
    return notes.join(e, near).withColumns({n: F.when(t, 1).otherwise(0) for n, t in tests.items()}).drop("_key", "_at")


def counts_by_window(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Rows per tumbling window; rows later than `late` behind the newest are left out by the watermark."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def two_codes_stream(events: DataFrame, patterns: list[str], over: int = 7, most: int = 365) -> DataFrame:
    """The rule of two codes over a stream (id, icd, date): a row (id, date, next_date, time_diff) for each consecutive pair of matching dates in the range.

    State per id: its last matching date (days since the epoch). Dates of an id must arrive in order; what comes earlier than the last date is left out.
    """
    hit = events.where(any_pattern("icd", patterns)).select("id", "date")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        days = sorted({(pd.Timestamp(x) - pd.Timestamp(0)).days for b in batches for x in b["date"] if x is not None})
        out = []
        for d in days:
            if last is not None and d < last:
                continue
            if last is not None and over < d - last <= most:
                out.append((key[0], (pd.Timestamp(0) + pd.Timedelta(days=last)).date(), (pd.Timestamp(0) + pd.Timedelta(days=d)).date(), d - last))
            last = d
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["id", "date", "next_date", "time_diff"])

    return hit.groupBy("id").applyInPandasWithState(step, "id string, date date, next_date date, time_diff int", "last int", "append", GroupStateTimeout.NoTimeout)
