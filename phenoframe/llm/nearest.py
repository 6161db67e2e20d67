"""Nearest-in-time join of two event tables within an entity (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenoframe.session import cut, shuffle_partitions

NONE = np.iinfo(np.int64).min
#: What a task writes. kind 0: a left row with the right records before and after it in the task; kind 1: the task's first and last right record.
_SCHEMA = "kind int, task int, entity string, left_id long, at long, prev_id long, prev_at long, next_id long, next_at long, entity_last string, ask_prev boolean, ask_next boolean"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [{"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _SCHEMA.split(", ")]


def _batch(n: int, **cols) -> pa.RecordBatch:
    arrays = []
    for name, kind in zip(_NAMES, _TYPES, strict=True):
        c = cols.get(name)
        if c is None:
            arrays.append(pa.nulls(n, kind))
        elif isinstance(c, np.ndarray) and kind == pa.int64():
            arrays.append(pa.array(c, kind, mask=c == NONE))
        elif np.isscalar(c):
            arrays.append(pa.array(np.full(n, c), kind))
        else:
            arrays.append(c if isinstance(c, pa.Array) else pa.array(c, kind))
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


class _Slice:
    """One task's slice, streamed: its rows come sorted by entity, time, side (0 right, 1 left) and id.

    What is carried from batch to batch are the last right record and the left rows that a right record still to come may be near to: those of the
    last entity within the tolerance of the last row. So what a task holds depends neither on the size of its slice nor on that of an entity.
    """

    def __init__(self, task: int, tolerance: int):
        self.task, self.tolerance = task, tolerance
        self.carried: pa.Table | None = None
        self.first_entity: str | None = None
        self.first_right: tuple | None = None  # entity, id, time
        self.last_right: tuple | None = None

    def step(self, batch: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Rows that are decided by a batch; without one, by the end of the slice."""
        parts = [x for x in (self.carried, batch) if x is not None and x.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        n, over = t.num_rows, batch is None
        ent, at = t.column("entity").combine_chunks(), t.column("at").combine_chunks().to_numpy(zero_copy_only=False)
        side, ident = t.column("side").to_numpy(), t.column("id").to_numpy()
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(ent.slice(1), ent.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        lengths = np.diff(np.r_[starts, n])
        start, end = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        right = side == 0
        before = np.maximum.accumulate(np.where(right, np.arange(n), -1))
        after = np.minimum.accumulate(np.where(right, np.arange(n), n)[::-1])[::-1]
        has_before, has_after = before >= start, after < end
        b, a = np.maximum(before, 0), np.minimum(after, n - 1)
        # Among right records of one time the least id serves; it is the first of their run.
        run_new = new | np.r_[True, at[1:] != at[:-1]]
        run_start = np.maximum.accumulate(np.where(run_new, np.arange(n), 0))
        b = run_start[b]
        left = ~right
        if n > 1:  # equal left rows are neighbours; one stays
            left[1:] &= new[1:] | (at[1:] != at[:-1]) | ~left[:-1] | (ident[1:] != ident[:-1])
        if self.first_entity is None:
            self.first_entity = ent[0].as_py()
        ask_prev = left & ~has_before & (start == 0) & (ent[0].as_py() == self.first_entity)
        wait = left & ~has_after & (end == n) & (at + self.tolerance >= at[-1])
        ask_next = wait & over
        near = (has_before & (at - at[b] <= self.tolerance)) | (has_after & (at[a] - at <= self.tolerance))
        k = np.flatnonzero(left & (near | ask_prev | ask_next) & (over | ~wait))
        for s in range(0, len(k), 50_000):
            j = k[s : s + 50_000]
            yield _batch(
                len(j), kind=0, task=self.task, entity=ent.take(pa.array(j)), left_id=ident[j], at=at[j],
                prev_id=np.where(has_before[j], ident[b[j]], NONE), prev_at=np.where(has_before[j], at[b[j]], NONE),
                next_id=np.where(has_after[j], ident[a[j]], NONE), next_at=np.where(has_after[j], at[a[j]], NONE),
                ask_prev=pa.array(ask_prev[j]), ask_next=pa.array(ask_next[j]),
            )
        r = np.flatnonzero(right)
        keep = np.flatnonzero(wait)
        if len(r):
            z = run_start[r[-1]]
            self.first_right = self.first_right or (ent[r[0]].as_py(), int(ident[r[0]]), int(at[r[0]]))
            self.last_right = (ent[z].as_py(), int(ident[z]), int(at[z]))
            if z >= starts[-1]:
                keep = np.r_[z, keep]
        self.carried = t.take(pa.array(keep)).combine_chunks()

    def edges(self) -> Iterator[pa.RecordBatch]:
        if self.first_right is not None:
            f, z = self.first_right, self.last_right
            yield _batch(1, kind=1, task=self.task, entity=pa.array([f[0]]), next_id=np.array([f[1]]), next_at=np.array([f[2]]), entity_last=pa.array([z[0]]), prev_id=np.array([z[1]]), prev_at=np.array([z[2]]))


def _scan(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = _Slice(TaskContext.get().partitionId(), tolerance)
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                yield from s.step(t.set_column(t.schema.get_field_index("at"), "at", t.column("at").cast(pa.int64())))
        yield from s.step(None)
        yield from s.edges()

    return run


def _prefix(edges: DataFrame, block: int) -> DataFrame:
    """For each task the last right record of the tasks before it and the first of those after it.

    A scan in two levels: within blocks of tasks in parallel, then over one row a block; its input has a row a task.
    """
    e = edges.withColumn("block", F.expr(f"task div {block}"))
    last = F.struct(F.col("entity_last").alias("entity"), F.col("prev_id").alias("id"), F.col("prev_at").alias("at"))
    first = F.struct(F.col("entity").alias("entity"), F.col("next_id").alias("id"), F.col("next_at").alias("at"))
    e = e.select("block", "task", F.when(F.col("prev_id").isNotNull(), last).alias("last"), F.when(F.col("next_id").isNotNull(), first).alias("first"))
    inner = Window.partitionBy("block").orderBy("task")
    e = e.withColumns({
        "in_last": F.last("last", True).over(inner.rowsBetween(Window.unboundedPreceding, -1)),
        "in_first": F.first("first", True).over(inner.rowsBetween(1, Window.unboundedFollowing)),
    })
    outer = Window.partitionBy(F.lit(0)).orderBy("block")
    tops = (
        e.groupBy("block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("task"))).alias("last"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("task"))).alias("first"))
        .withColumns({
            "out_last": F.last("last", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)),
            "out_first": F.first("first", True).over(outer.rowsBetween(1, Window.unboundedFollowing)),
        })
        .select("block", "out_last", "out_first")
    )
    return e.join(F.broadcast(tops), "block").select("task", F.coalesce("in_last", "out_last").alias("p"), F.coalesce("in_first", "out_first").alias("q"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_entity: str, left_at: str, right_id: str, right_entity: str, right_at: str, hours: float, partitions: int | None = None) -> DataFrame:
    """Each left row with the nearest right row of the same entity at most `hours` away, before or after: left_id, right_id, apart_us.

    Both tables are range-partitioned together by entity, time and id, so that an entity may fill any number of tasks;
    each task scans its slice, and the first and last right record of each task reach the neighbours through a prefix scan.
    The slices' outcome is written to the checkpoint folder once, as the partitioning must not be computed twice.

    A distance equal to the tolerance counts. Of two equally near right rows the earlier serves, of one time the least id.
    Rows with a null id, entity or time pair with nothing and do not come out, nor do left rows without a partner. Left rows repeated
    with the same id, entity and time come out once. Ids are integers; entities compare as strings. Empty tables give an empty result.
    """
    spark = left.sparkSession
    n = partitions or shuffle_partitions(spark)

    def side(df: DataFrame, which: int, ident: str, entity: str, at: str) -> DataFrame:
        df = df.select(F.col(entity).cast("string").alias("entity"), F.col(at).cast("timestamp_ntz").alias("at"), F.lit(which).cast("byte").alias("side"), F.col(ident).cast("long").alias("id"))
        return df.where("entity is not null and at is not null and id is not null")

    both = side(right, 0, right_id, right_entity, right_at).unionByName(side(left, 1, left_id, left_entity, left_at))
    order = ["entity", "at", "side", "id"]
    tolerance = round(hours * 3_600_000_000)
    scanned = cut(both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan(tolerance), _SCHEMA))
    edges = scanned.where("kind = 1")
    tasks = spark.range(n).select(F.col("id").cast("int").alias("task")).join(edges.drop("kind"), "task", "left")
    carry = _prefix(tasks, max(2, round(n**0.5)))
    rows = scanned.where("kind = 0").join(F.broadcast(carry), "task")  # carry has one row a task
    prev_id = F.when(F.col("ask_prev") & (F.col("p.entity") == F.col("entity")), F.col("p.id")).otherwise(F.col("prev_id"))
    prev_at = F.when(F.col("ask_prev") & (F.col("p.entity") == F.col("entity")), F.col("p.at")).otherwise(F.col("prev_at"))
    next_id = F.when(F.col("ask_next") & (F.col("q.entity") == F.col("entity")), F.col("q.id")).otherwise(F.col("next_id"))
    next_at = F.when(F.col("ask_next") & (F.col("q.entity") == F.col("entity")), F.col("q.at")).otherwise(F.col("next_at"))
    far = F.lit(1 << 62)
    rows = rows.select("left_id", prev_id.alias("b"), next_id.alias("a"), F.coalesce(F.col("at") - prev_at, far).alias("db"), F.coalesce(next_at - F.col("at"), far).alias("da"))
    apart = F.least("db", "da")
    return rows.where(apart <= tolerance).select(F.col("left_id"), F.when(F.col("db") <= F.col("da"), F.col("b")).otherwise(F.col("a")).alias("right_id"), apart.alias("apart_us"))
