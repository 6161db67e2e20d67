"""Joins of a spine of notes with dated events, and the blocks of features they give."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoframe.functions.dates import months, shift
from phenoframe.session import cut, shuffle_partitions

#: Spine rows and events, more or less, of the tiles into which rows_in_window cuts a key's period, and slots of its table of counts. The runs of events
#: are short, as a file's compression looks back no further than 64 KB and finds a run again only at the same bit of a byte.
TILE, SLOTS = {"_s": 8192, "_e": 256}, 1 << 20


def keep_known(df: DataFrame, spine: DataFrame, key: str = "id") -> DataFrame:
    """Rows of df whose key the spine has."""
    return df.join(spine.select(key).distinct(), key, "left_semi")


def in_window(spine: DataFrame, events: DataFrame, back: str, ahead: str, key: str = "id", date: str = "date") -> DataFrame:
    """Pairs of a spine row and an event of the same key, event date - back <= spine date <= event date + ahead, both ends inclusive.

    The bounds are computed on the event's side, as clamping at month ends makes it matter; they stay a residual of the
    equi-join on the key, so no pair outside the window leaves the join.
    """
    e = events.withColumnRenamed(date, "_at").withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & F.col(date).between(shift("_at", f"-{back}"), shift("_at", ahead))
    return spine.join(e, near).drop("_key", "_at")


def rows_in_window(spine: DataFrame, events: DataFrame, back: str, ahead: str, key: str = "id", date: str = "date", more: dict[str, Column] | None = None) -> DataFrame:
    """The pairs of in_window, between the distinct rows of either side, for keys of any number of rows; `more` are columns computed from the spine's, once a row.

    Events have a period of some months, spine rows are copied to the periods that their window touches, and rows meet by key and period. A period with more rows
    of a side than TILE is cut into tiles, so that a key fills many tasks; which periods are is told by a table of SLOTS counts, in which two of them may meet:
    that makes copies, no other pairs. Each table is shuffled once. Equal rows fall into the same tiles and are taken once there, by the order that the join needs
    too, with dates behind the keys: a row then meets a run of events, as the row before it did, which files of the result hold in little space.
    """
    before, after = months(back), months(ahead)
    long = max(1, (before + after) // 4)
    number = F.year(date) * 12 + F.month(date) - 1
    whole = lambda n: F.floor(n / long).cast("int")
    touched = F.sequence(whole(number - after), whole(number + before))
    left, right = spine.columns, [c for c in events.columns if c not in (key, date)]
    s = spine.where(F.col(date).isNotNull()).withColumn("_period", F.explode(touched))
    e = events.where(F.col(date).isNotNull()).withColumn("_period", whole(number))
    slot = F.pmod(F.hash(key, "_period"), F.lit(SLOTS)).alias("_slot")
    counts = s.select(slot, F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionAll(e.select(slot, F.lit(0).alias("_s"), F.lit(1).alias("_e"))).groupBy("_slot")
    tiles = counts.agg(*(F.greatest(F.lit(1), F.ceil(F.sum(c) / rows).cast("int")).alias(c) for c, rows in TILE.items())).where("_s + _e > 2")

    meet = ["_period", "_tile", key]

    def tiled(df: DataFrame, own: str, other: str, tile: Column) -> DataFrame:
        """Rows in the tile column of their own side, copied to all tiles of the other one."""
        d = df.withColumn("_slot", slot).join(F.broadcast(tiles), "_slot", "left").na.fill(1, ["_s", "_e"])
        d = d.withColumn("_own", F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        d = d.select(*df.columns, tile.alias("_tile"))
        d = d.repartition(shuffle_partitions(df.sparkSession), *meet)  # by number: the work of a task is in its pairs, which its bytes don't tell
        rest = [date, *(c for c in df.columns if c not in (key, date, "_period"))]
        before = Window.partitionBy(*meet).orderBy(*rest)
        again = reduce(lambda a, b: a & b, (F.lag(c).over(before).eqNullSafe(F.col(c)) for c in rest))
        return d.withColumn("_again", again).where("not _again").drop("_again")

    s = tiled(s, "_s", "_e", F.col("_own") * F.col("_e") + F.col("_other")).withColumns(more or {})
    e = tiled(e, "_e", "_s", F.col("_other") * F.col("_e") + F.col("_own"))
    e = e.select(*right, F.col(key).alias("_key"), F.col("_period").alias("_at"), F.col("_tile").alias("_in"), shift(date, f"-{back}").alias("_from"), shift(date, ahead).alias("_to"))
    same = (F.col("_period") == F.col("_at")) & (F.col("_tile") == F.col("_in")) & (F.col(key) == F.col("_key"))
    return s.join(e, same & F.col(date).between(F.col("_from"), F.col("_to"))).select(*left, *(more or {}), *right)


def looked_back(spine: DataFrame, events: DataFrame, back: str, key: str = "id", date: str = "date") -> DataFrame:
    """Pairs with spine date - back <= event date <= spine date; the bound is computed on the spine's side."""
    e = events.withColumnRenamed(date, "_at").withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & F.col("_at").between(shift(date, f"-{back}"), F.col(date))
    return spine.join(e, near).drop("_key", "_at")


def flags(pairs: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """One row per keys with a 0/1 column for each test that any of the pairs passes."""
    return pairs.groupBy(*keys).agg(*(F.max(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()))


def exists_flag(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    return pairs.select(*keys).distinct().withColumn(name, F.lit(1))


def back_to_spine(spine: DataFrame, *blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Every spine row with the blocks' columns, 0 where a block has no row. Blocks must be unique in keys."""
    out = reduce(lambda a, b: a.join(b, keys, "left"), blocks, spine)
    new = [c for b in blocks for c in b.columns if c not in keys]
    return out.na.fill(0, new)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that is an error if either side repeats a key (checked by an aggregation of each side)."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the {side} side repeats keys of {keys}")
    return left.join(right, keys, how)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal to null keys."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(r, on, how).drop(*(f"_r_{k}" for k in keys))


def common_keys(left: DataFrame, right: DataFrame, among: tuple[str, ...] = ("id", "date", "note_idx"), how: str = "inner") -> DataFrame:
    """A join on those of the given key columns that both sides have."""
    on = [c for c in among if c in left.columns and c in right.columns]
    if not on:
        raise ValueError("no key column in common")
    return left.join(right, on, how)


def renamed_join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """A join whose keys have other names on the right (left name: right name); the right's key columns go."""
    r = right.withColumnsRenamed({b: f"_r_{b}" for b in on.values()})
    test = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_r_{b}") for a, b in on.items()))
    return left.join(r, test, how).drop(*(f"_r_{b}" for b in on.values()))


def ever_flag(spine: DataFrame, events: DataFrame, test: Column, name: str, key: str = "id") -> DataFrame:
    """The spine with a 0/1 column: whether its key ever had an event that passes the test."""
    had = events.where(test).select(key).distinct().withColumn(name, F.lit(1))
    return spine.join(had, key, "left").na.fill(0, [name])


def demographics(spine: DataFrame, demo: DataFrame, key: str = "id", date: str = "date") -> DataFrame:
    """The spine with age (difference of calendar years) and sex (1 male, 0 other, null unknown). Ids with differing rows are an error."""
    d = demo.distinct()
    if not d.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a person has differing demographic rows")
    sex = F.when(F.lower("sex").isin("m", "male"), 1).when(F.col("sex").isNull(), None).otherwise(0)
    return spine.join(d, key, "left").withColumns({"age": F.year(date) - F.year("date_of_birth"), "sex": sex}).drop("date_of_birth")


def _look_ahead(key: str, date: str, name: str):
    """A task's sorted rows with the date of the same key's next row in it; the first row's key and date and whether a row is the last stand beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def out(rows: pa.Table, following: pa.Table | None, first: bool) -> Iterator[pa.RecordBatch]:
            n = rows.num_rows
            ahead = pa.concat_tables([rows.slice(1), following.slice(0, 1)]) if following is not None else rows.slice(1)
            k, k2 = rows.column(key).combine_chunks(), ahead.column(key).combine_chunks()
            m = len(k2)
            same = pc.fill_null(pc.or_(pc.fill_null(pc.equal(k.slice(0, m), k2), False), pc.and_(pc.is_null(k.slice(0, m)), pc.is_null(k2))), False)
            nxt = pc.if_else(same, ahead.column(date).combine_chunks(), pa.scalar(None, rows.schema.field(date).type))
            if m < n:
                nxt = pa.concat_arrays([nxt.combine_chunks() if isinstance(nxt, pa.ChunkedArray) else nxt, pa.nulls(1, rows.schema.field(date).type)])
            at = np.arange(n)
            flags = [nxt, pa.array(np.full(n, task, dtype=np.int32)), pa.array((at == 0) & first), pa.array((at == n - 1) & (m < n))]
            for i, c in enumerate((name, "_p", "_first", "_last")):
                rows = rows.append_column(c, flags[i])
            yield from rows.combine_chunks().to_batches(max_chunksize=50_000)

        held, first = None, True
        for b in batches:
            if b.num_rows:
                now = pa.Table.from_batches([b])
                if held is not None:
                    yield from out(held, now, first)
                    first = False
                held = now
        if held is not None:
            yield from out(held, None, first)

    return run


def with_next(df: DataFrame, key: str, date: str, *tie: str, name: str = "next_date") -> DataFrame:
    """df with the date of the same key's next row, in the order of date and tie; null for a key's last row. Null keys count as one key.

    Rows are range-partitioned by key and date, so that a key may fill any number of tasks; each task looks ahead as its sorted slice streams by, and the
    first row of the next slice, one row a task, serves the last row of each. One shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, df.schema[date].dataType), T.StructField("_p", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])
    s = cut(df.repartitionByRange(n, key, date, *tie).sortWithinPartitions(key, date, *tie).mapInArrow(_look_ahead(key, date, name), schema))
    first = s.where("_first").select("_p", F.struct(F.col(key).alias("k"), F.col(date).alias("d")).alias("_f"))
    ahead = first.select("_p", F.lead("_f").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("_f"))
    s = s.join(F.broadcast(ahead), "_p", "left")
    return s.withColumn(name, F.when(F.col("_last") & F.col(key).eqNullSafe(F.col("_f.k")) & F.col("_f").isNotNull(), F.col("_f.d")).otherwise(F.col(name))).select(*df.columns, name)


def texts_of_day(df: DataFrame, keys: list[str], text: str, order: str, sep: str = " ") -> DataFrame:
    """Texts of the same keys joined in the order of a column, and the first row's value of it; null texts are left out."""
    got = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.array_join(F.transform(got, lambda x: x[text]), sep).alias(text))


def numbered(df: DataFrame, *order: str | Column, name: str = "note_idx") -> DataFrame:
    """df with a gapless 0-based number by the given order as its first column.

    Partitions are numbered in parallel: a range partitioning by the order, a count of each partition, and an offset from the counts - no single-task
    window. The order must be unique, else equal rows share their numbers in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    s = cut(s.withColumn("_k", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_m"))
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return s.join(F.broadcast(offsets), "_p").select((F.col("_o") + F.col("_k")).alias(name), *df.columns)


def by_day(events: DataFrame, tests: dict[str, Column], key: str = "id", date: str = "date") -> DataFrame:
    """One row per key and day with the tests' flags: what a window may see of a day. However many events a key has, it has no more rows than days."""
    return events.groupBy(key, date).agg(*(F.max(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()))


def _paired(spine: DataFrame, events: DataFrame, tests: dict[str, Column], any_of: Column | None, pair, key: str, date: str, undated: bool) -> DataFrame:
    e = by_day(events.where(any_of) if any_of is not None else events, tests, key, date)  # pre-aggregated before any shuffle by key
    top = [F.max(n).alias(n) for n in tests]
    found = pair(spine.select(key, date).distinct(), e).groupBy(key, date).agg(*top)
    if not undated:
        return back_to_spine(spine, found, keys=[key, date])
    ever = spine.where(F.col(date).isNull()).select(key).distinct().join(e.groupBy(key).agg(*top), key).withColumn(date, F.lit(None).cast(spine.schema[date].dataType))
    return null_safe(spine, found.unionByName(ever), [key, date], "left").na.fill(0, list(tests))


def windowed_features(spine: DataFrame, events: DataFrame, back: str, ahead: str, tests: dict[str, Column], any_of: Column | None = None, key: str = "id", date: str = "date", undated: bool = False) -> DataFrame:
    """The spine with a 0/1 column for each test that an event of the key passes within the window around the row's date.

    Events are first combined to days and spine rows to distinct days, so that a hot key pairs days with days, never rows with rows. If undated, spine rows without a
    date meet all events of their key; else they meet none.
    """
    return _paired(spine, events, tests, any_of, lambda d, e: in_window(d, e, back, ahead, key, date), key, date, undated)


def lookback_features(spine: DataFrame, events: DataFrame, back: str, tests: dict[str, Column], any_of: Column | None = None, key: str = "id", date: str = "date", undated: bool = False) -> DataFrame:
    """As windowed_features, for events up to `back` before the row's date and on it."""
    return _paired(spine, events, tests, any_of, lambda d, e: looked_back(d, e, back, key, date), key, date, undated)
