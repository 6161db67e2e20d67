"""Queries through the engine, and the remaining relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenoframe.functions import stem, text
from phenoframe.operators import codes, metrics, ml, score, temporal
from phenoframe.plans.base import Book, cpt, icd, med, notes, scored, sql
from phenoframe.plans.engine import Engine, Registry
from phenoframe.plans.phenotypes import Phenotype
from phenoframe.plans.texts import std, words_of
from phenoframe.sources import tables
from phenoframe.session import cut, table

query = Book()


def _rule(spark: SparkSession, d: str, name: str) -> DataFrame:
    return Engine(spark).predict(name, icd=icd(spark, d).select("id", "icd", "date"), cpt=cpt(spark, d).select("id", "cpt", "date"))


def _any(patterns: str) -> str:
    return sql(f"select id, icd, date, 1 as prediction from i where regexp_matches(icd, '{patterns}')")


@query(sql("""
select id, icd, date, next_date, (next_date - date)::int as time_diff, 1 as prediction from (
  select id, icd, date, lead(date) over (partition by id order by date, icd) as next_date from i where regexp_matches(icd, '^427\\.?31|^427\\.?32|^I48.*'))
where next_date - date > 7 and next_date - date <= 365"""), dates=("date", "next_date"))
def phenotype_atrial_fibrillation(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, "af").drop("note_idx")


@query(_any(r"^410\.?.0|^410\.?.1|^I21|^I22"), dates=("date",))
def phenotype_myocardial_infarction(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, "mi").drop("note_idx")


@query(_any(r"^433\.?.1|^434\.?.1|^436|^I63|^I64"), dates=("date",))
def phenotype_ischemic_stroke(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, "is_icd").drop("note_idx")


@query(_any("^250.*|^E08.*|^E09.*|^E10.*|^E11.*|^E12.*|^E13.*|^E14.*"), dates=("date",))
def phenotype_diabetes(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, "dm").drop("note_idx")


@query(sql(r"""
select id, icd as code, date, 1 as prediction, 'icd' as code_type from i where regexp_matches(icd, '^410.*|^411.*|^412|^413.*|^414.*|^V45\.?81|^I21.*|^I22.*|^I23.*|^I24.*|^I25.*|^Z95\.?1')
union all select id, cpt, date, 1, 'cpt' from c where regexp_matches(cpt, '92920|92921|92924|92925|92928|92929|92933|92934|92937|92938|92941|92973|92975|92977|93455|93457|93459')"""), dates=("date",))
def phenotype_coronary_artery_disease(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, "cad").drop("note_idx")


_COLS = {"id": "string", "date": "date"}
_NOTE = {**_COLS, "note": "string"}


def _predicted(spark: SparkSession, d: str, p: Phenotype) -> DataFrame:
    """The prediction of a phenotype declared in code over notes, diagnoses and medications; `index` is the note's own number."""
    r = Registry()
    r.register_model(p)
    n = notes(spark, d).select(F.col("idx").alias("index"), "id", "date", "note")
    tables_ = {"note": n, "icd": icd(spark, d).select("id", "date", "icd"), "med": med(spark, d).select("id", "date", "med")}
    out = Engine(spark, r).predict(p.name, {k: t for k, t in tables_.items() if k in p.inputs})
    return out.drop("date").select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.drop("date").dtypes))


def _numbered(select: str, ctes: str = "", source: str = "x") -> str:
    return sql(f"select * from (with x as (select row_number() over (order by idx) - 1 as note_idx, idx, id, date, note from n){ctes} select note_idx, id, {select} from {source})")


def _code(role: str, column: str, pattern: str, months: int) -> str:
    return f"exists (select 1 from {role} e where e.id = x.id and regexp_matches(e.{column}, '{pattern}') and x.date between e.date - interval {months} month and e.date + interval {months} month)::int"


_SHAKING = {
    "window": "6mo", "icd": ["^G20", "^R56"], "med": ["velumodor", "haloplemate"], "keywords": ["tremor", "neck stiff", "stare spell"], "negators": ["no", "not", "deni"], "history": ["histori"],
    "weights": {"g20": 1.5, "velumodor": 0.25, "tremor_": 1.0, "tremor_neg_": -1.0}, "bias": -1.0,
}
_TREMOR = "list_has_any(s, ['tremor', 'tremors'])"
_DENIED = "list_has_any(s, ['no', 'not', 'deny', 'denies', 'denied'])"
_LOGIT = "1 / (1 + exp(-({})))"
_P = "round(1 - p, 6) as \"prob_NO\", round(p, 6) as \"prob_YES\", (p > 0.5)::int as prediction"


@query(_numbered(_P, rf""",
z as (select note_idx, {words_of("note")} as ss from x),
y as (select x.note_idx, x.id, {_LOGIT.format(f"-1.0 + 1.5 * {_code('i', 'icd', '^G20', 6)} + 0.25 * {_code('m', 'med', 'velumodor', 6)} + (len(list_filter(coalesce(ss, []), lambda s: {_TREMOR} and not {_DENIED})) > 0)::int - (len(list_filter(coalesce(ss, []), lambda s: {_TREMOR} and {_DENIED})) > 0)::int")} as p from x join z using (note_idx))""", "y"))
def phenotype_by_keywords(spark: SparkSession, d: str) -> DataFrame:
    """A keyword phenotype declared in code, over notes, diagnoses and medications: one prediction per note."""
    return _predicted(spark, d, Phenotype("shaking", "keywords", {"note": _NOTE, "icd": {**_COLS, "icd": "string"}, "med": {**_COLS, "med": "string"}}, _SHAKING))


_COUNTED = {"ngrams": ["seizure", "head ct", "mg"], "weights": {"seizure_": 0.5, "head_ct_": 1.0, "mg_": -0.25}, "bias": 0.1}


def _grams(g: str) -> str:
    return rf"coalesce(len(regexp_extract_all(' ' || replace({std()}, ' ', '  ') || ' ', '(^|[^a-z]){g.replace(' ', '  ')}[^a-z]')), 0)"


_WEIGHED = "0.1 + " + " + ".join(f"{w} * {_grams(g)}" for g, w in zip(_COUNTED["ngrams"], _COUNTED["weights"].values(), strict=True))


@query(_numbered(_P, f", y as (select *, {_LOGIT.format(_WEIGHED)} as p from x)", "y"))
def phenotype_by_counts(spark: SparkSession, d: str) -> DataFrame:
    """A phenotype by counts of n-grams."""
    return _predicted(spark, d, Phenotype("counted", "counts", {"note": _NOTE}, _COUNTED))


_TASKED = {"patterns": {"mri": r"\bmri\b", "spell": "spells?", "dose": r"\d+ mg"}, "tasks": {"any": {"weights": {"mri_": 1.0, "spell_": 0.5}, "bias": -0.5}, "strong": {"weights": {"spell_": 2.0, "dose_": -1.0}, "threshold": 0.6}}}
_LABELLED = {"patterns": _TASKED["patterns"], "labels": {"first": {"weights": {"mri_": 1.0, "absent_": 5.0}, "bias": -1.0}, "second": None, "third": {"weights": {"dose_": 1.0}, "threshold": 0.7}}}


def _has(name: str) -> str:
    return f"coalesce(regexp_matches(lower(note), '{_TASKED['patterns'][name]}'), false)::int"


_ANY, _STRONG, _FIRST, _THIRD = (_LOGIT.format(x) for x in (f"-0.5 + {_has('mri')} + 0.5 * {_has('spell')}", f"2.0 * {_has('spell')} - {_has('dose')}", f"-1.0 + {_has('mri')}", _has("dose")))


@query(_numbered(f"round({_ANY}, 6) as prob_any, ({_ANY} >= 0.5)::int as pred_any, round({_STRONG}, 6) as prob_strong, ({_STRONG} >= 0.6)::int as pred_strong"))
def phenotype_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Several tasks with thresholds of their own, which themselves count."""
    return _predicted(spark, d, Phenotype("tasked", "patterns", {"note": _NOTE}, _TASKED))


@query(_numbered(f"round({_FIRST}, 6) as prob_first, ({_FIRST} > 0.5)::int as pred_first, round({_THIRD}, 6) as prob_third, ({_THIRD} > 0.7)::int as pred_third"))
def phenotype_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Several labels with features of their own; one has no model, one asks for a feature that there is not."""
    return _predicted(spark, d, Phenotype("labelled", "patterns", {"note": _NOTE}, _LABELLED))


_MCI = Registry().resolve("mci")
_MCI_FEATURES = ", ".join(f"coalesce(regexp_matches(t, '{x}'), false)::int as {codes.feature_name(x)}_" for x in _MCI.params["patterns"])


@query(sql(f"""
select * from (with x as (select row_number() over (order by idx) - 1 as note_idx, id, lower(note) as t from n)
select note_idx, id, (id in (select id from i where regexp_matches(icd, '{"|".join(_MCI.params["icd"]["patterns"])}')))::int as icd,
  (id in (select id from m where regexp_matches(med, '{"|".join(_MCI.params["med"]["patterns"])}')))::int as med, {_MCI_FEATURES} from x)"""))
def features_mild_cognitive_impairment(spark: SparkSession, d: str) -> DataFrame:
    """The features of a bundled phenotype: patterns on the note, codes and medications ever."""
    n = notes(spark, d).select(F.col("idx").alias("index"), "id", "note")
    return Engine(spark).features("mci", note=n, icd=icd(spark, d).select("id", "icd", "date"), med=med(spark, d).select("id", "med", "date"))


def _bundled(spark: SparkSession, d: str, name: str) -> DataFrame:
    n = notes(spark, d).select(F.col("idx").alias("index"), "id", "date", "note")
    roles = {"icd": icd(spark, d).select("id", "icd", "date"), "med": med(spark, d).select("id", "med", "date"), "cpt": cpt(spark, d).select("id", "cpt", "date")}
    e = Engine(spark)
    return e.features(name, {"note": n, **{r: t for r, t in roles.items() if r in e.get_data_format(name)}}).drop("date")


@query()
def features_subdural_hematoma(spark: SparkSession, d: str) -> DataFrame:
    """Bags over stems with negation and history, diagnoses and groups of procedures in the window."""
    return _bundled(spark, d, "sdh")


@query()
def features_traumatic_brain_injury(spark: SparkSession, d: str) -> DataFrame:
    """Bags over stems with negation and a pair of a verb and the head."""
    return _bundled(spark, d, "tbi")


@query()
def features_parkinsons_disease(spark: SparkSession, d: str) -> DataFrame:
    """Keywords under windowed negation."""
    return _bundled(spark, d, "pd")


@query()
def features_withdrawal_of_life_support(spark: SparkSession, d: str) -> DataFrame:
    """Patterns on the stemmed whole note."""
    return _bundled(spark, d, "wlst")


#: Two small trees of a booster's dump.
TREES = [
    {"nodeid": 0, "split": "seizure", "split_condition": 1, "yes": 1, "no": 2, "missing": 1, "children": [
        {"nodeid": 1, "split": "mg", "split_condition": 2, "yes": 3, "no": 4, "missing": 4, "children": [{"nodeid": 3, "leaf": -0.5}, {"nodeid": 4, "leaf": 0.25}]}, {"nodeid": 2, "leaf": 0.75}]},
    {"nodeid": 0, "split": "grp", "split_condition": 2.5, "yes": 1, "no": 2, "missing": 2, "children": [{"nodeid": 1, "leaf": -0.125}, {"nodeid": 2, "leaf": 0.5}]},
]


@query(f"""
select note_id, round(p, 6) as prob from (
  select note_id, 1 / (1 + exp(-(case when {_grams("seizure")} < 1 then case when {_grams("mg")} < 2 then -0.5 else 0.25 end else 0.75 end + case when grp < 2.5 then -0.125 else 0.5 end))) as p
  from notes where note is not null)""")
def booster_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees from a dump over counts of n-grams and a source that may be null, features in an explicit order."""
    n = table(spark, d, "notes").where("note is not null").select("note_id", "grp", text.clean_standard("note").alias("c"))
    f = n.select("note_id", "grp", text.ngram_count("c", "mg").alias("mg"), text.ngram_count("c", "seizure").alias("seizure"))
    return score.boosted(f, score.Booster(TREES, ["seizure", "mg", "grp"])).select("note_id", F.round("prob", 6).alias("prob"))


@query("select * from (values " + ", ".join(f"('{n}', {int('note' in p.inputs)}, {int('icd' in p.inputs)}, {int('cpt' in p.inputs)}, '{p.kind}')" for n, p in sorted(Registry().models.items())) + ") t(name, note, icd, cpt, kind)")
def registry_grid(spark: SparkSession, d: str) -> DataFrame:
    """Which tables each registered phenotype takes. Both sides read the registry, there is no other source: the grid itself is what is checked."""
    r = Registry()
    rows = [(n, int("note" in p.inputs), int("icd" in p.inputs), int("cpt" in p.inputs), p.kind) for n, p in sorted(r.models.items())]
    return spark.createDataFrame(rows, "name string, note int, icd int, cpt int, kind string")


@query("select patient_id as id, count(*) as n, max(loaded_at)::date as last from (select patient_id, loaded_at from icd union all select patient_id, loaded_at from med union all select patient_id, loaded_at from cpt) group by 1", dates=("last",))
def multi_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """One table from three files, by a glob and by name, of which only the columns in common are read."""
    one = tables.read_parquet(spark, f"{d}/[im][ce]d.parquet", f"{d}/cpt.parquet", schema="patient_id string, loaded_at timestamp_ntz")
    return one.groupBy(F.col("patient_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.to_date(F.max("loaded_at")).alias("last"))


@query(sql("select id, count(*) as n from i where year(date) > 2015 and left(icd, 1) not in ('I', 'G') group by 1"))
def year_and_state_filter(spark: SparkSession, d: str) -> DataFrame:
    return icd(spark, d).where((F.year("date") > 2015) & ~F.substring("icd", 1, 1).isin("I", "G")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("select bdsp_patient_id as id, max(annot) as label, arg_min(hospital, note_id) as first_hospital, count(*) as n from notes where annot is not null and hospital is not null group by 1")
def labels_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The largest label of each patient's notes and the site of the first of them."""
    n = table(spark, d, "notes").where("annot is not null and hospital is not null")
    return n.groupBy(F.col("bdsp_patient_id").alias("id")).agg(F.max("annot").alias("label"), F.min_by("hospital", "note_id").alias("first_hospital"), F.count(F.lit(1)).alias("n"))


@query(sql("select key, case when label = 1 and score >= 0.5 then 'high' when label = 1 then 'low' end as class from s where label = 1"))
def label_map(spark: SparkSession, d: str) -> DataFrame:
    """Values replaced by a map; those mapped to nothing go."""
    s = scored(spark, d).withColumn("k", F.concat_ws("_", F.col("label").cast("string"), (F.col("score") >= 0.5).cast("int").cast("string")))
    m = F.create_map(*(F.lit(x) for kv in {"1_1": "high", "1_0": "low"}.items() for x in kv))
    return s.select("key", F.try_element_at(m, F.col("k")).alias("class")).where("class is not null")


@query(sql("select key, coalesce(label, 0) as label, 0 as absent, score as score from s"))
def aligned_features(spark: SparkSession, d: str) -> DataFrame:
    return score.aligned_features(scored(spark, d), ["key"], ["label", "absent", "score"])


@query(sql("select id, max((icd = 'I63213')::int) as a_b_, max((icd = 'G2091')::int) as c from i group by 1"))
def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    t = {"a[b]": F.col("icd") == "I63213", "c": F.col("icd") == "G2091"}
    return codes.safe_names(temporal.flags(icd(spark, d), ["id"], t))


@query(sql("select grp, key, score, row_number() over (partition by grp order by score desc, key) as place from s qualify place <= 3"))
def top_rows_per_group(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    s = scored(spark, d)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "key"))  # the planner limits each task's groups before the shuffle
    return s.select("grp", "key", "score", place.cast("long").alias("place")).where("place <= 3")


@query()
def lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Content words with English plurals undone by rule, filtered once more."""
    c = text.content_words("note", ["the", "and", "was", "with"], ["lp"])
    n = table(spark, d, "notes").where("note is not null").select("note_id", F.split(c, " ").alias("w"))
    return n.select("note_id", F.array_join(F.filter(stem.stem_words("w", "noun"), lambda w: F.length(w) > 2), " ").alias("lemmas"))


@query()
def ml_leave_one_source_out(spark: SparkSession, d: str) -> DataFrame:
    """For each source, the AUC on its rows of a model trained on all others."""
    from pyspark.ml.classification import LogisticRegression

    words = ["tremor", "falls", "clinic", "seizure"]
    n = table(spark, d, "notes").where("annot in (0, 1) and note is not null and grp is not null")
    f = cut(n.select("grp", F.col("annot").alias("label"), *(text.matches(F.lower("note"), w).alias(w) for w in words)))
    out = None
    for name, train, test in ml.left_out(f, "grp"):
        model = ml.scaled_pipeline(train, words, LogisticRegression(labelCol="label")).fit(train)
        auc = metrics.roc_auc(ml.probability(model.transform(test)), "label", "prob").select(F.lit(name).alias("source"), "roc_auc")
        out = auc if out is None else out.unionByName(auc)
    return out
