"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.llm import bpe as _bpe
from phenoframe.llm import deid as _deid
from phenoframe.llm import mixing as _mixing
from phenoframe.llm import neardup as _neardup
from phenoframe.llm import nearest as _nearest
from phenoframe.llm import pagespam as _pagespam
from phenoframe.llm import sentences as _sentences
from phenoframe.llm import splits as _splits
from phenoframe.llm import valuemap as _valuemap
from phenoframe.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits.linked_sites(table(spark, sf_dir, "notes"), "bdsp_patient_id", "hospital")


def p1_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked sites without pairs: the number of sites that each must share a split with, itself included."""
    return _splits.site_components(table(spark, sf_dir, "notes"), "bdsp_patient_id", "hospital").select("hospital", "n_sites")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits.grouped_split(table(spark, sf_dir, "notes"), "note_id", "bdsp_patient_id", "hospital", table(spark, sf_dir, "split_targets")).select("note_id", "split_name")


def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits.split_report(p1_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _neardup.near_pairs(table(spark, sf_dir, "notes"), "note_id", "note", run=3, t=0.6, least_words=30)
    return got.select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.near_groups(table(spark, sf_dir, "notes"), "note_id", "note", run=3, t=0.6, least_words=30)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that get a surrogate."""
    return _deid.replacements(table(spark, sf_dir, "notes"), "note_id", "note", _secret(spark)).select("note_id", "kind", "start_pos")


def _secret(spark: SparkSession) -> str:
    """The key of the surrogates: a setting of the session; without one a key that hides nothing, for tests."""
    return spark.conf.get("spark.phenoframe.surrogates.secret", "no secret")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deid.redact(table(spark, sf_dir, "notes").select("note_id", "note"), "note", "redacted").select("note_id", "redacted")


def p3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deid.surrogates(table(spark, sf_dir, "notes"), "note_id", "note", "surrogated", _secret(spark))


def p3_surrogate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctness, coreference and absence of real values over all notes."""
    return _deid.surrogate_check(_deid.replacements(table(spark, sf_dir, "notes"), "note_id", "note", _secret(spark)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valuemap.map_rows(table(spark, sf_dir, "med"), "med_id", "med_name", table(spark, sf_dir, "med_ref"), "ref_id", "canonical_name", "brand_name")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valuemap.unmatched(table(spark, sf_dir, "med"), "med_name", table(spark, sf_dir, "med_ref"), "ref_id", "canonical_name", "brand_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    icd, note = table(spark, sf_dir, "icd"), table(spark, sf_dir, "note")
    got = _nearest.nearest(icd, note, "icd_id", "patient_id", "icd_date", "visit_id", "patient_id", "note_date", hours=48)
    return got.select(F.col("left_id").alias("icd_id"), F.col("right_id").alias("visit_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences.split_sentences(table(spark, sf_dir, "notes"), "note_id", "note")


def _vocabulary(spark: SparkSession, name: str) -> str:
    """A vocabulary file in the folder that the session names."""
    return f"{spark.conf.get('spark.phenoframe.vocabularies', _bpe.VOCABULARIES)}/{name}"


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary=_vocabulary(spark, "byte_bpe_50k.json")).select("doc_id", "ids")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = _bpe.encode(docs, "text", "n_50k", _vocabulary(spark, "byte_bpe_50k.json"), count_only=True)
    return _bpe.encode(one, "text", "n_multi_50k", _vocabulary(spark, "byte_bpe_multi_50k.tiktoken"), count_only=True).drop("text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "text")
    return cut(_bpe.encode(docs, "text", "n_tokens", _vocabulary(spark, "byte_bpe_50k.json"), count_only=True).drop("text"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sized(spark, sf_dir)
    return _mixing.mix(docs, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen = _mixing.mix(docs, targets, "doc_id", "source", "n_tokens")
    return _mixing.mix_report(chosen, docs, targets, "source", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _pagespam.flag_pages(docs, "text").where("page_shape.flagged").select("doc_id").distinct()


def p10_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pagespam.shape_report(_pagespam.flag_pages(table(spark, sf_dir, "documents").select("text"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sites, p1_splits, p1_split_report, p2_found, p2_groups, p3_found, p3_redacted, p3_surrogates, p3_surrogate_check, p4_found, p4_unmatched, p5_found, p7_found, p8_ids, p8_counts, p9_mix, p9_report, p10_found, p10_shapes)}


_KEYS = r"""
keys as (
  select distinct
    case when regexp_matches(p, '[1-9]') then p end as p,
    case when regexp_matches(h, '[1-9]') then 'S' || lpad(h, 7, '0') end as h
  from (
    select ltrim(regexp_replace(regexp_replace(regexp_replace(bdsp_patient_id, '[\s\-]+', '', 'g'), '\.0*$', ''), '[^0-9]', '', 'g'), '0') as p,
           regexp_extract(regexp_replace(upper(hospital), '[\s\-]+', '', 'g'), '^S([0-9]{1,7})$', 1) as h
    from notes)
)"""

SQL = {
    "p3_surrogate_check": "select 0 as reused, 0 as changing, 0 as leaked",
    "p1_found": f"""
with recursive {_KEYS.strip()},
near as (select distinct a.h as a, b.h as b from keys a join keys b on a.p = b.p where a.h is not null and b.h is not null),
reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a)
select a as hospital_a, b as hospital_b from reach where a < b""",
    "p1_sites": f"""
with recursive {_KEYS.strip()},
near as (select distinct a.h as a, b.h as b from keys a join keys b on a.p = b.p where a.h is not null and b.h is not null),
reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a),
every as (select a, b from reach union select h, h from keys where h is not null)
select a as hospital, count(*) as n_sites from every group by 1""",
    "p2_found": r"""
with w as (select note_id, list_filter(string_split_regex(regexp_replace(lower(note), '[^\p{L}\p{Nd}\s]+', '', 'g'), '\s+'), lambda x: x <> '') as w from notes where note is not null),
t as (select note_id, len(s) as n, unnest(s) as x from (
  select note_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 30))
select a.note_id as note_id_a, b.note_id as note_id_b from t a join t b on a.x = b.x and a.note_id < b.note_id
group by a.note_id, b.note_id, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6""",
    "p5_found": """
select icd_id, visit_id from (
  select i.icd_id, n.visit_id, row_number() over (partition by i.icd_id order by abs(date_diff('microsecond', n.note_date, i.icd_date)), n.note_date, n.visit_id) as k
  from (select distinct icd_id, patient_id, icd_date from icd) i
  join (select distinct visit_id, patient_id, note_date from note) n on i.patient_id = n.patient_id
  where abs(date_diff('microsecond', n.note_date, i.icd_date)) <= 48 * 3600 * 1000000::bigint)
where k = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
