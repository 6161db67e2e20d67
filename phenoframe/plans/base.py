"""Registration of queries with their SQL, and the tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.session import table


class Book:
    """Queries and SQL of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, dates: tuple[str, ...] = ()):
        """Register a query; the named date columns come out as strings on both sides, so that they compare alike everywhere."""

        def add(f: Callable[[SparkSession, str], DataFrame]):
            @wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates}) if dates else f(spark, d)

            self.queries[f.__name__] = run
            if sql is not None:
                self.sql[f.__name__] = f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in dates)}) from ({sql})" if dates else sql
            return f

        return add


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Dated notes, each visit once: idx, id, date, note."""
    n = table(spark, d, "note").where("patient_id is not null and note_date is not null")
    return n.select(F.col("visit_id").alias("idx"), F.col("patient_id").alias("id"), F.to_date("note_date").alias("date"), F.col("note_text").alias("note")).distinct()


def spine_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of spine as often as the table has them."""
    n = table(spark, d, "note").where("patient_id is not null and note_date is not null")
    return n.select(F.col("visit_id").alias("idx"), F.col("patient_id").alias("id"), F.to_date("note_date").alias("date"))


def spine(spark: SparkSession, d: str) -> DataFrame:
    """The notes without their texts: the distinct never carries them through a shuffle."""
    return spine_rows(spark, d).distinct()


def icd_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of icd as often as the table has them."""
    t = table(spark, d, "icd").where("patient_id is not null and icd_date is not null and icd_code is not null")
    return t.select(F.col("icd_id").alias("key"), F.col("patient_id").alias("id"), F.to_date("icd_date").alias("date"), F.regexp_replace(F.upper("icd_code"), "[^A-Z0-9]+", "").alias("icd"))


def icd(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis codes, each row once: key, id, date, icd (upper case, without dots and blanks)."""
    return icd_rows(spark, d).distinct()


def med(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "med").where("patient_id is not null and med_date is not null and med_name is not null")
    return t.select(F.col("med_id").alias("key"), F.col("patient_id").alias("id"), F.to_date("med_date").alias("date"), F.lower("med_name").alias("med")).distinct()


def cpt(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cpt").where("patient_id is not null and cpt_date is not null and cpt_code is not null")
    return t.select(F.col("cpt_id").alias("key"), F.col("patient_id").alias("id"), F.to_date("cpt_date").alias("date"), F.col("cpt_code").alias("cpt")).distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Annotated notes with a fixed made-up score: key, grp, label, score."""
    n = table(spark, d, "notes").where("annot in (0, 1) and grp is not null")
    return n.select(F.col("note_id").alias("key"), "grp", F.col("annot").alias("label"), (F.pmod(F.col("note_id") * 7919 + F.col("annot") * 211, F.lit(1000)) / 1000.0).alias("score"))


CTE = r"""
n as (select distinct visit_id as idx, patient_id as id, note_date::date as date, note_text as note from note where patient_id is not null and note_date is not null),
i as (select distinct icd_id as key, patient_id as id, icd_date::date as date, regexp_replace(upper(icd_code), '[^A-Z0-9]+', '', 'g') as icd from icd where patient_id is not null and icd_date is not null and icd_code is not null),
m as (select distinct med_id as key, patient_id as id, med_date::date as date, lower(med_name) as med from med where patient_id is not null and med_date is not null and med_name is not null),
c as (select distinct cpt_id as key, patient_id as id, cpt_date::date as date, cpt_code as cpt from cpt where patient_id is not null and cpt_date is not null and cpt_code is not null),
s as (select note_id as key, grp, annot as label, ((note_id * 7919 + annot * 211) % 1000) / 1000.0::double as score from notes where annot in (0, 1) and grp is not null)
"""


def sql(text: str) -> str:
    return f"with {CTE.strip()}\n{text.strip()}"
