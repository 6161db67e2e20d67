"""Problem 6: the feature table of the event tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.operators import eventfeatures
from phenoframe.session import table

def p6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventfeatures.coded_features(table(spark, sf_dir, "icd"), table(spark, sf_dir, "med"), table(spark, sf_dir, "code_list"))

def p6_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features as rows (patient_id, feature, n, days, total), without the empty ones: checks the wide table."""
    wide = p6_features(spark, sf_dir)
    names = [c[2:] for c in wide.columns if c.startswith("n_")]
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"n_{n}").alias("n"), F.col(f"days_{n}").alias("days"), (F.col(f"total_{n}") if n != "med" else F.lit(0.0)).alias("total")) for n in names))
    return wide.select("patient_id", F.explode(F.filter(cells, lambda x: x["n"] > 0)).alias("x")).select("patient_id", "x.feature", "x.n", "x.days", "x.total")

QUERIES = {"p6_features": p6_features, "p6_long": p6_long}
SQL = {
    "p6_long": r"""
with i as (select * from (select *, row_number() over (partition by icd_id order by loaded_at desc) as k from icd where icd_id is not null) where k = 1),
m as (select * from (select *, row_number() over (partition by med_id order by loaded_at desc) as k from med where med_id is not null) where k = 1),
e as (select greatest((select max(icd_date) from icd), (select max(med_date) from med))::date as day),
c as (select regexp_replace(upper(icd_code), '[^A-Z0-9]+', '', 'g') as code, lower(regexp_replace(icd_code, '[^0-9A-Za-z]+', '_', 'g')) as feature from code_list)
select patient_id, feature, count(*) as n, ((select day from e) - max(icd_date::date))::int as days, sum(round(coalesce(charge, 0) * 100)::bigint)::bigint / 100.0 as total
from i join c on regexp_replace(upper(i.icd_code), '[^A-Z0-9]+', '', 'g') = c.code where patient_id is not null group by 1, 2
union all
select patient_id, 'med', count(*), ((select day from e) - max(med_date::date))::int, 0.0 from m where patient_id is not null group by 1""",
}
