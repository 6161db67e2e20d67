"""Queries on codes and dates: rules, joins in time, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.operators import codes, rules, temporal
from phenoframe.plans.base import Book, cpt, icd, icd_rows, med, notes, scored, spine, spine_rows, sql
from phenoframe.session import table

query = Book()
HEART = ["^I21", "^I25"]
STROKE = ["^I6[1-4]"]
KEYS = ["idx", "id", "date"]


@query(sql("select key, id, date, icd, 1 as prediction from i where regexp_matches(icd, '^I21|^I25')"), dates=("date",))
def rule_any_code(spark: SparkSession, d: str) -> DataFrame:
    return rules.any_code(icd(spark, d), "icd", HEART)


@query(sql("""
select key, id, date, icd, next_date, (next_date - date)::int as time_diff, 1 as prediction from (
  select *, lead(date) over (partition by id order by date, key) as next_date from i where regexp_matches(icd, '^I48'))
where next_date - date > 7 and next_date - date <= 365"""), dates=("date", "next_date"))
def rule_two_codes_gap(spark: SparkSession, d: str) -> DataFrame:
    return rules.two_codes(icd(spark, d), "icd", ["^I48"], tie=("key",))


@query(sql("""
select key, id, date, icd as code, 1 as prediction, 'icd' as code_type from i where regexp_matches(icd, '^I25')
union all select key, id, date, cpt, 1, 'cpt' from c where regexp_matches(cpt, '33|929')"""), dates=("date",))
def rule_union_codes(spark: SparkSession, d: str) -> DataFrame:
    return rules.union_codes([(icd(spark, d), "icd", ["^I25"], "icd"), (cpt(spark, d), "cpt", ["33", "929"], "cpt")])


def _window_sql(names: dict[str, str], months: int, table_: str = "i", column: str = "icd") -> str:
    flag = ", ".join(f"max(case when regexp_matches(e.{column}, '{p}') then 1 else 0 end) as {n}" for n, p in names.items())
    out = ", ".join(f"coalesce(b.{n}, 0)::int as {n}" for n in names)
    return sql(f"""
select n.idx, n.id, n.date, {out} from n left join (
  select n.idx, n.id, n.date, {flag} from n join {table_} e on n.id = e.id
  where n.date between e.date - interval {months} month and e.date + interval {months} month group by all) b using (idx, id, date)""")


FLAGS = {"i63": "^I63", "g20": "^G20", "r56": "^R56"}


@query(_window_sql(FLAGS, 6), dates=("date",))
def interval_join_flags(spark: SparkSession, d: str) -> DataFrame:
    return temporal.windowed_features(spine(spark, d), icd(spark, d), "6mo", "6mo", {n: F.col("icd").rlike(p) for n, p in FLAGS.items()}, codes.any_pattern("icd", list(FLAGS.values())))


@query(sql("""
select n.idx, n.id, n.date, case when exists (select 1 from i where i.id = n.id and regexp_matches(icd, '^I6[1-4]')
  and n.date between i.date - interval 18 month and i.date + interval 18 month) then 1 else 0 end as icd from n"""), dates=("date",))
def interval_join_exists(spark: SparkSession, d: str) -> DataFrame:
    return temporal.windowed_features(spine(spark, d), icd(spark, d), "18mo", "18mo", {"icd": F.lit(True)}, codes.any_pattern("icd", STROKE))


@query(sql("""
select a, b, n.date from (select distinct idx as a, id, date from n) n join (select distinct key as b, id, date as seen from i) i on n.id = i.id
where n.date between seen - interval 6 month and seen + interval 6 month"""), dates=("date",))
def interval_join_month_end(spark: SparkSession, d: str) -> DataFrame:
    """Each note a with each diagnosis b whose window of six months, clamped at month ends, holds its date."""
    n, i = spine_rows(spark, d).withColumnRenamed("idx", "a"), icd_rows(spark, d).select(F.col("key").alias("b"), "id", "date")
    text = {"_text": F.col("date").cast("string")}  # dates become texts before the join, not once a pair
    return temporal.rows_in_window(n, i, "6mo", "6mo", more=text).select("a", "b", F.col("_text").alias("date"))


@query(sql("""
select n.idx, n.id, n.date, coalesce(b.vel, 0)::int as vel, coalesce(b.hal, 0)::int as hal from n left join (
  select n.idx, n.id, n.date, max(case when contains(m.med, 'velumodor') then 1 else 0 end) as vel, max(case when contains(m.med, 'haloplemate') then 1 else 0 end) as hal
  from n join m on n.id = m.id where m.date between n.date - interval 24 month and n.date group by all) b using (idx, id, date)"""), dates=("date",))
def lookback_join_flags(spark: SparkSession, d: str) -> DataFrame:
    tests = {"vel": F.col("med").contains("velumodor"), "hal": F.col("med").contains("haloplemate")}
    return temporal.lookback_features(spine(spark, d), med(spark, d), "2y", tests, F.col("med").rlike("velumodor|haloplemate"))


@query(sql("select n.idx, n.id, n.date, case when n.id in (select id from i where regexp_matches(icd, '^G20')) then 1 else 0 end as ever from n"), dates=("date",))
def ever_flag_semi(spark: SparkSession, d: str) -> DataFrame:
    return temporal.ever_flag(spine(spark, d), icd(spark, d), F.col("icd").rlike("^G20"), "ever")


@query(sql("select key, id, date, icd from i where id in (select id from n)"), dates=("date",))
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    return temporal.keep_known(icd(spark, d), spine(spark, d))


@query("""
select a.note_id, b.n from notes a join (select grp, annot, count(*) as n from notes group by all) b
on a.grp is not distinct from b.grp and a.annot is not distinct from b.annot""")
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").select("note_id", "grp", "annot")
    return temporal.null_safe(n, n.groupBy("grp", "annot").agg(F.count(F.lit(1)).alias("n")), ["grp", "annot"]).select("note_id", "n")


@query(sql("select n.idx, n.id, n.date, coalesce(b.x, 0) as x from n left join (select idx, length(note) as x from n where length(note) > 80) b using (idx)"), dates=("date",))
def left_back_to_spine(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    block = n.where(F.length("note") > 80).select(*KEYS, F.length("note").cast("long").alias("x"))
    return temporal.one_to_one(n.select(*KEYS), block, KEYS).na.fill(0, ["x"])


@query("""
with n as (select distinct visit_id as idx, patient_id as id, note_date::date as date from note where patient_id is not null and note_date is not null),
d as (select distinct patient_id as id, date_of_birth as b, sex as s from demo where patient_id is not null)
select n.idx, n.id, n.date, (year(date) - year(b))::int as age, case when lower(s) in ('m', 'male') then 1 when s is null then null else 0 end as sex from n left join d using (id)""", dates=("date",))
def demo_age_sex(spark: SparkSession, d: str) -> DataFrame:
    """Demographic rows as they are, repeated ones and uneven values included."""
    p = table(spark, d, "demo").where("patient_id is not null").select(F.col("patient_id").alias("id"), "date_of_birth", "sex")
    return temporal.demographics(spine(spark, d), p)


_UNDATED = "(select distinct visit_id as idx, patient_id as id, note_date::date as date from note where patient_id is not null)"


@query(sql(f"""
select n.idx, n.id, n.date, coalesce(max(case when regexp_matches(icd, '^I63') then 1 else 0 end), 0)::int as i63, coalesce(max(case when regexp_matches(icd, '^G20') then 1 else 0 end), 0)::int as g20
from {_UNDATED} n left join i on n.id = i.id and (n.date is null or n.date between i.date - interval 12 month and i.date + interval 12 month) group by all"""), dates=("date",))
def interval_join_undated(spark: SparkSession, d: str) -> DataFrame:
    """Notes without a date meet all events of their patient."""
    n = table(spark, d, "note").where("patient_id is not null").select(F.col("visit_id").alias("idx"), F.col("patient_id").alias("id"), F.to_date("note_date").alias("date")).distinct()
    tests = {"i63": F.col("icd").rlike("^I63"), "g20": F.col("icd").rlike("^G20")}
    return temporal.windowed_features(n, icd(spark, d), "1y", "1y", tests, codes.any_pattern("icd", ["^I63", "^G20"]), undated=True)


@query("select doc_id, d.bdsp_patient_id as id, date_of_birth as born from documents d left join (select distinct patient_id, date_of_birth from demo) p on d.bdsp_patient_id = p.patient_id", dates=("born",))
def differing_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the birth dates of a table that calls the key by another name."""
    p = table(spark, d, "demo").select("patient_id", F.col("date_of_birth").alias("born")).distinct()
    return temporal.renamed_join(table(spark, d, "documents").select("doc_id", F.col("bdsp_patient_id").alias("id")), p, {"id": "patient_id"})


@query("select note_id, grp, annot from notes where grp is not null and annot is not null")
def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("note_id", "grp", "annot").na.drop("any")


@query(sql("select grp, s.key, label, n from s join (select grp, count(*) as n from s group by 1) using (grp)"))
def dynamic_key_join(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return temporal.common_keys(s.select("grp", "key", "label"), s.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), among=("id", "grp", "note_idx"))


GROUPS = {"stroke": "^I6[1-4]", "cerebro": "^I6", "heart": "^I[24]", "seizure": "^R56|^G40"}
_GROUPED = " ".join(f"when regexp_matches(icd, '{p}') then '{g}'" for g, p in GROUPS.items())


@query(sql(f"select g, count(*) as n, count(distinct id) as patients from (select id, case {_GROUPED} else 'other' end as g from i) group by 1"))
def ordered_code_grouping(spark: SparkSession, d: str) -> DataFrame:
    g = icd(spark, d).select("id", codes.first_group("icd", GROUPS, F.lit("other")).alias("g"))
    return g.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("patients"))


@query(_window_sql({"imaging": "^70|^71", "visit": "^99"}, 6, "c", "cpt"), dates=("date",))
def grouped_pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    groups = {"imaging": ["^70", "^71"], "visit": ["^99"]}
    return temporal.windowed_features(spine(spark, d), cpt(spark, d), "6mo", "6mo", codes.group_tests("cpt", groups))


@query(sql("select id, max(case when starts_with(icd, 'I63') or starts_with(icd, 'I61') then 1 else 0 end)::int as stroke, max(case when starts_with(icd, 'G20') then 1 else 0 end)::int as parkinson from i group by 1"))
def prefix_flags(spark: SparkSession, d: str) -> DataFrame:
    return temporal.flags(icd(spark, d), ["id"], codes.prefix_tests("icd", {"stroke": ["I63", "I61"], "parkinson": ["G20"]}))


MEDS = {"velumodor": "velumodor", "sidoxadaspyl": "velumodor", "haloplemate": "haloplemate", "kolamithymine": "kolamithymine"}
_CANON = " ".join(f"when contains(med, '{a}') then '{b}'" for a, b in MEDS.items())


@query(sql(f"select key, id, canonical from (select key, id, case {_CANON} end as canonical from m) where canonical is not null"))
def first_match_canonical(spark: SparkSession, d: str) -> DataFrame:
    return med(spark, d).select("key", "id", codes.first_canonical("med", MEDS).alias("canonical")).where("canonical is not null")


@query(sql(f"""
select id, max((x = 'velumodor')::int) as velumodor, max((x = 'haloplemate')::int) as haloplemate, max((x = 'never_given')::int) as never_given
from (select id, coalesce(case {_CANON} end, '') as x from m) group by 1"""))
def med_one_hot_pad(spark: SparkSession, d: str) -> DataFrame:
    m = med(spark, d).select("id", codes.first_canonical("med", MEDS).alias("x"))
    return codes.one_hot(m, ["id"], "x", ["velumodor", "haloplemate", "never_given"])


@query(sql("""
select id, a + b + c as n, greatest(a, b) as a, c from (
  select id, max((starts_with(icd, 'I63'))::int) as a, max((starts_with(icd, 'I61'))::int) as b, max((starts_with(icd, 'G20'))::int) as c from i group by 1)"""))
def horizontal_sum_max(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.flags(icd(spark, d), ["id"], codes.prefix_tests("icd", {"a": ["I63"], "b": ["I61"], "c": ["G20"]}))
    return codes.merge_synonyms(codes.total(f, ["a", "b", "c"], "n"), [("a", "b")])


ORDERED = {"stroke": "^I6[1-4]", "cerebro": "^I6", "seizure": "^R56|^G40"}
_FLAGGED = ", ".join(f"coalesce(max(case when n.date between i.date - interval 6 month and i.date + interval 6 month and g = '{g}' then 1 else 0 end), 0)::int as {g}" for g in ORDERED)


@query(sql(f"""
select *, (stroke + cerebro)::int as n_icds from (
  select n.idx, n.id, n.date, {_FLAGGED} from n left join (select id, date, case {" ".join(f"when regexp_matches(icd, '{p}') then '{g}'" for g, p in ORDERED.items())} end as g from i) i on n.id = i.id group by all)"""), dates=("date",))
def ordered_group_features(spark: SparkSession, d: str) -> DataFrame:
    """A flag for the first group that each code belongs to, 0 without events in the window, and the number of groups but the last."""
    g = codes.first_group("icd", ORDERED)
    f = temporal.windowed_features(spine(spark, d), icd(spark, d), "6mo", "6mo", {n: F.coalesce(g == n, F.lit(False)) for n in ORDERED})
    return codes.total(f, ["stroke", "cerebro"], "n_icds")


DRUGS = {"velumodor": "velumodor|sidoxadaspyl", "haloplemate": "^haloplemate", "tablet": r"\btab"}
_DRUG = " ".join(f"when regexp_matches(med, '{p}') then '{g}'" for g, p in DRUGS.items())


@query(sql(f"select canonical, count(*) as n, count(distinct id) as patients from (select id, case {_DRUG} else med end as canonical from m) group by 1"))
def med_groups_else_text(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern that a medication matches, else its own text."""
    g = med(spark, d).select("id", codes.first_group("med", DRUGS, F.col("med")).alias("canonical"))
    return g.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("patients"))
