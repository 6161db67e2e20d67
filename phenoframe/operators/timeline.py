"""Event timelines per patient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.operators.temporal import with_next


def first_positive(df: DataFrame, key: str, kind: str, date: str, test: Column) -> DataFrame:
    """The first date per key and kind among the rows that pass the test."""
    return df.where(test).groupBy(key, kind).agg(F.min(date).alias("first_date"))


def spans(events: DataFrame, ends: list[DataFrame], key: str = "id", start: str = "start_date", tie: str = "state") -> DataFrame:
    """Events (key, state, start_date) with end_date: the least of the key's next event and of the dates in `ends` (key, one date column)."""
    out = with_next(events, key, start, tie, name="_next")
    last = ["_next"]
    for k, e in enumerate(ends):
        c = next(c for c in e.columns if c != key)
        out = out.join(e.select(key, F.col(c).alias(f"_end{k}")), key, "left")
        last.append(f"_end{k}")
    return out.withColumn("end_date", F.least(*last) if len(last) > 1 else F.col("_next")).drop(*last)


def aligned(events: DataFrame, align: DataFrame, key: str = "id", start: str = "start_date") -> DataFrame:
    """Events with day_offset from the key's alignment date (key, align_date); keys without one are left out."""
    return events.join(align, key).withColumn("day_offset", F.datediff(start, "align_date"))


def extents(events: DataFrame, key: str = "id", start: str = "start_date", state: str = "state") -> DataFrame:
    """Per key: first and last date, number of events, and the distinct states in order."""
    return events.groupBy(key).agg(F.min(start).alias("first_date"), F.max(start).alias("last_date"), F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set(state)), ",").alias("states"))
