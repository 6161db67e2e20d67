"""Queries on table shape and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.operators import metrics, temporal, timeline
from phenoframe.plans.base import Book, icd, med, notes, scored, spine, sql
from phenoframe.session import table

query = Book()


@query(sql("select grp, coalesce(sum(case when label = 0 then 1 end), 0)::bigint as no, coalesce(sum(case when label = 1 then 1 end), 0)::bigint as yes, count(*) as total from s group by 1"))
def pivot_class_by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.crosstab(scored(spark, d).withColumn("c", F.when(F.col("label") == 1, "yes").otherwise("no")), "grp", "c", ["no", "yes"])


@query(sql("""
select grp, no, yes, no + yes as total from (select coalesce(grp::int::varchar, case when grouping(grp) = 1 then 'TOTAL' end) as grp,
  coalesce(sum(case when label = 0 then 1 end), 0)::bigint as no, coalesce(sum(case when label = 1 then 1 end), 0)::bigint as yes from s group by rollup (grp))"""))
def crosstab_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Classes by source with a last row for all of them."""
    s = scored(spark, d).select(F.col("grp").cast("int").alias("grp"), F.when(F.col("label") == 1, "yes").otherwise("no").alias("c"))
    return metrics.crosstab(s, "grp", "c", ["no", "yes"], total_row="TOTAL")


@query("select annot, count(*) as n from notes group by 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").groupBy("annot").agg(F.count(F.lit(1)).alias("n"))


_COLS = ["note_id", "grp", "hospital", "bdsp_patient_id", "date_note", "note", "annot"]


@query(" union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls from notes" for c in _COLS))
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.null_counts(table(spark, d, "notes").select(*_COLS))


@query(sql("select id, date, icd as code, null::bigint as quantity from i where starts_with(icd, 'I63') union all select id, date, null, 1 from m where starts_with(med, 'velumodor')"), dates=("date",))
def union_relaxed(spark: SparkSession, d: str) -> DataFrame:
    a = icd(spark, d).where(F.col("icd").startswith("I63")).select("id", "date", F.col("icd").alias("code"))
    b = med(spark, d).where(F.col("med").startswith("velumodor")).select("id", "date", F.lit(1).cast("long").alias("quantity"))
    return a.unionByName(b, allowMissingColumns=True)


@query(sql("select distinct id, date from n"), dates=("date",))
def distinct_spine(spark: SparkSession, d: str) -> DataFrame:
    return spine(spark, d).select("id", "date").distinct()


@query(sql("select row_number() over (order by id, date, idx) - 1 as note_idx, idx, id from n"))
def row_index(spark: SparkSession, d: str) -> DataFrame:
    return temporal.numbered(spine(spark, d), "id", "date", "idx").select("note_idx", "idx", "id")


@query(sql("select id, left(icd, 3) as kind, min(date) as first_date from i where left(icd, 3) in ('I63', 'I61', 'G20') group by 1, 2"), dates=("first_date",))
def first_positive(spark: SparkSession, d: str) -> DataFrame:
    i = icd(spark, d).withColumn("kind", F.substring("icd", 1, 3))
    return timeline.first_positive(i, "id", "kind", "date", F.col("kind").isin("I63", "I61", "G20"))


@query(sql("select id, idx, date, lead(date) over (partition by id order by date, idx) as next_date from n"), dates=("date", "next_date"))
def next_event_lead(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_next(spine(spark, d), "id", "date", "idx")


def _events(spark: SparkSession, d: str) -> DataFrame:
    i = icd(spark, d).withColumn("state", F.substring("icd", 1, 3)).where(F.col("state").isin("I63", "I61", "G20", "R56"))
    return i.groupBy("id", "state").agg(F.min("date").alias("start_date"))


_EV = "ev as (select id, left(icd, 3) as state, min(date) as start_date from i where left(icd, 3) in ('I63', 'I61', 'G20', 'R56') group by 1, 2)"


@query(sql(f"""select * from (with {_EV} select ev.*, least(lead(start_date) over (partition by ev.id order by start_date, state), l.last, x.gone) as end_date
from ev left join (select id, max(date) as last from n group by 1) l on ev.id = l.id left join (select id, max(date) as gone from m group by 1) x on ev.id = x.id)"""), dates=("start_date", "end_date"))
def timeline_end_dates(spark: SparkSession, d: str) -> DataFrame:
    """An event ends with the patient's next one, the last note or the last medication, whichever comes first."""
    last = spine(spark, d).groupBy("id").agg(F.max("date").alias("last"))
    return timeline.spans(_events(spark, d), [last, med(spark, d).groupBy("id").agg(F.max("date").alias("gone"))])


@query(sql(f"select * from (with {_EV} select ev.id, state, (start_date - a.d)::int as day_offset from ev join (select id, min(date) as d from n group by 1) a on ev.id = a.id)"))
def aligned_day_offsets(spark: SparkSession, d: str) -> DataFrame:
    a = spine(spark, d).groupBy("id").agg(F.min("date").alias("align_date"))
    return timeline.aligned(_events(spark, d), a).select("id", "state", "day_offset")


@query(sql(f"select * from (with {_EV} select id, min(start_date) as first_date, max(start_date) as last_date, count(*) as n_events, string_agg(distinct state, ',' order by state) as states from ev group by 1)"), dates=("first_date", "last_date"))
def timeline_extents(spark: SparkSession, d: str) -> DataFrame:
    return timeline.extents(_events(spark, d))


@query("select note_id, row_number() over (order by annot nulls last, note_id) as place from notes")
def nulls_last_sort(spark: SparkSession, d: str) -> DataFrame:
    """The place of every note, nulls last."""
    order = F.asc_nulls_last("annot"), F.asc_nulls_last("note_id")
    return temporal.numbered(table(spark, d, "notes").select("note_id", "annot"), *order, name="_n").select("note_id", (F.col("_n") + 1).alias("place"))


@query(sql("select id, count(*) as n_notes, count(distinct date) as n_days, min(date) as first_date, max(date) as last_date from n group by 1"), dates=("first_date", "last_date"))
def patient_extent(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n_notes"), F.count_distinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
