"""One wide row of counts, recency and totals per entity from event tables (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.session import shuffle_partitions

#: Events that a task combines before the shuffle at once.
COMBINE = 400_000
NO_DAY = int(np.iinfo(np.int32).min)


def code_key(c: Column | str) -> Column:
    """A code without its writing: upper case, letters and digits only; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.upper(c.cast("string")), r"[^A-Z0-9]+", "")
    return F.when(F.length(bare) > 0, bare)


def feature_name(code: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", code.strip().lower())


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial runs (entity, type, n, cents, last) of a task's events, so that a hot entity crosses the shuffle in few rows."""

    def partial(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["entity", "type"]).aggregate([("n", "sum"), ("cents", "sum"), ("last", "max")])
        t = t.select(["entity", "type", "n_sum", "cents_sum", "last_max"]).rename_columns(["entity", "type", "n", "cents", "last"])
        yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= COMBINE:
            yield from partial(held)
            held, size = [], 0
    if held:
        yield from partial(held)


def _wide(k: int, names: list[str], end: int):
    """Rows of partial runs, sorted by entity, become one wide row an entity: sums, and the latest time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ent = table.column("entity").combine_chunks()
            ent = ent.chunk(0) if isinstance(ent, pa.ChunkedArray) else ent
            n = len(ent)
            new = np.r_[True, pc.not_equal(ent.slice(1), ent.slice(0, n - 1)).to_numpy(zero_copy_only=False)] if n > 1 else np.ones(1, dtype=bool)
            row, first = np.cumsum(new) - 1, np.flatnonzero(new)
            for s in range(0, len(first), 2000):
                e = min(s + 2000, len(first))
                lo, hi = first[s], (first[e] if e < len(first) else n)
                r, part = row[lo:hi] - s, table.slice(lo, hi - lo)
                ty, cnt, cents, last = (pc.fill_null(part.column(c), NO_DAY if c == "last" else 0).to_numpy() for c in ("type", "n", "cents", "last"))
                count, total = np.zeros((e - s, k), dtype=np.int64), np.zeros((e - s, k), dtype=np.int64)
                latest = np.full((e - s, k), NO_DAY, dtype=np.int32)
                real = ty >= 0  # type -1 only announces an entity
                r, ty = r[real], ty[real]
                np.add.at(count, (r, ty), cnt[real])
                np.add.at(total, (r, ty), cents[real])
                np.maximum.at(latest, (r, ty), last[real])
                none = latest == NO_DAY
                cols = [ent.take(pa.array(first[s:e]))]
                for j in range(k):
                    cols += [pa.array(count[:, j]), pa.array(end - latest[:, j], pa.int32(), mask=none[:, j]), pa.array(total[:, j] / 100.0)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < 200_000:
                continue
            t = pa.Table.from_batches(held)
            ent = t.column("entity")
            before = pc.not_equal(ent, ent[len(ent) - 1]).to_numpy(zero_copy_only=False)
            at = int(np.flatnonzero(before)[-1]) + 1 if before.any() else 0
            if at:
                yield from emit(t.slice(0, at).combine_chunks())
                held = t.slice(at).to_batches()
            else:  # one entity fills all that is held: its runs are merged, so what is held stays bounded
                held = list(_combine(iter(t.to_batches())))
            size = sum(x.num_rows for x in held)
        if size:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def wide_features(events: DataFrame, types: list[str], as_of: str | None = None) -> DataFrame:
    """One row per entity: entity, and for each type its n, days (since the last event) and total.

    events holds (entity string, type int - an index into types, or -1 to give the entity a row only -, day date, amount double), each event once.
    Amounts are added as whole hundredths, so the sums are exact and do not depend on the order. Every task first combines its own events
    to runs by entity and type, so that a hot entity is pre-aggregated; then runs are bucketed by entity, sorted by entity and type, and streamed
    into wide rows in the one shuffle. Rows with a null entity or type are left out. A null day counts as an event without recency, a null amount as 0.
    Days are counted up to as_of (a date), else to the latest day of any event; they are null, n and total 0, for types without events.
    """
    k = len(types)
    e = events.where("entity is not null and type is not null")
    if as_of is None:
        as_of = e.agg(F.max("day").cast("string")).first()[0]
    e = e.select("entity", F.col("type").cast("int").alias("type"), F.when(F.col("type") >= 0, 1).otherwise(0).cast("long").alias("n"), F.round(F.coalesce("amount", F.lit(0.0)) * 100).cast("long").alias("cents"), F.unix_date("day").alias("last"))
    runs = e.mapInArrow(_combine, "entity string, type int, n long, cents long, last int")
    names = ["entity"] + [f"{x}_{t}" for t in types for x in ("n", "days", "total")]
    schema = "entity string, " + ", ".join(f"`n_{t}` long, `days_{t}` int, `total_{t}` double" for t in types)
    n = shuffle_partitions(events.sparkSession)
    end = (date.fromisoformat(as_of) - date(1970, 1, 1)).days if as_of else 0
    return runs.repartition(n, "entity").sortWithinPartitions("entity", "type").mapInArrow(_wide(k, names, end), schema)


def once(df: DataFrame, key: str, later: str) -> DataFrame:
    """One row for each key, the one loaded last (of equals any); rows without a key are left out."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(later, *[c for c in rest if c != later])).alias("_row"))
    return best.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def coded_features(icd: DataFrame, med: DataFrame, codes: DataFrame, as_of: str | None = None) -> DataFrame:
    """patient_id with n, days and total charge for each listed icd code, and n_med and days_med for all medications.

    A patient comes out who has any keyed icd or med row, be it of no listed code. Keys that come twice count once, by the row loaded last. Codes are compared
    without case, dots and blanks; the list (a small table) may hold at most 5,000 codes. Null patients are left out. Days count to the latest date of both tables unless as_of is given.
    """
    listed = codes.where("icd_code is not null").orderBy("code_id").limit(5001).collect()
    if len(listed) > 5000:
        raise ValueError("more than 5,000 codes make no wide row")
    keys = {re.sub(r"[^A-Z0-9]+", "", r["icd_code"].upper()): r["icd_code"] for r in reversed(listed)}
    names = [feature_name(r["icd_code"]) for r in listed if keys.get(re.sub(r"[^A-Z0-9]+", "", r["icd_code"].upper())) == r["icd_code"]]
    names = list(dict.fromkeys(names))
    index = {k: names.index(feature_name(v)) for k, v in keys.items()}
    spark = icd.sparkSession
    lookup = spark.createDataFrame(list(index.items()), "code string, type int")
    i = once(icd.select("icd_id", "patient_id", "icd_date", "icd_code", "charge", "loaded_at"), "icd_id", "loaded_at")
    i = i.withColumn("code", code_key("icd_code")).join(F.broadcast(lookup), "code", "left")  # at most 5,000 rows
    i = i.select(F.col("patient_id").alias("entity"), F.coalesce("type", F.lit(-1)).alias("type"), F.to_date("icd_date").alias("day"), F.col("charge").alias("amount"))
    m = once(med.select("med_id", "patient_id", "med_date", "loaded_at"), "med_id", "loaded_at")
    m = m.select(F.col("patient_id").alias("entity"), F.lit(len(names)).alias("type"), F.to_date("med_date").alias("day"), F.lit(None).cast("double").alias("amount"))
    if as_of is None:
        ends = [icd.agg(F.max("icd_date").alias("d")), med.agg(F.max("med_date").alias("d"))]
        as_of = ends[0].unionByName(ends[1]).agg(F.max(F.to_date("d")).cast("string")).first()[0]
    return wide_features(i.unionByName(m), [*names, "med"], as_of).drop("total_med").withColumnRenamed("entity", "patient_id")
