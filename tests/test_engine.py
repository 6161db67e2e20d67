from datetime import date

import pytest
from pyspark.sql import functions as F

from phenoframe.plans.engine import Engine, Registry
from phenoframe.sources import schema, tables
from phenoframe.streaming import scoring

D = date
KEYWORDS = """name: shaky
aliases: [sh]
kind: keywords
inputs:
  note: {id: string, note: string, date: !pl Date}
  icd: {id: string, icd: string, date: !pl Date}
params:
  window: 6mo
  icd: ['^I48']
  keywords: ['hand tremor', 'fall']
  negators: ['no', 'not']
  history: ['histori']
  pairs: [{name: hit_strike, any_of: [hit, struck], with: head}]
  weights: {i48: 1.0, hand_tremor_: 2.0, fall_neg_: -1.0}
  bias: -0.5
"""
SCALE = """name: scale
kind: scale
inputs:
  note: {id: string, note: string}
params: {ngrams: ['weak', 'arm'], weights: {weak_: 50.0}, bias: -3, range: [0, 42], stated_grades: true}
"""


@pytest.fixture
def icd(spark):
    return spark.createDataFrame([("a", "I48.1", D(2020, 1, 1)), ("a", "I48.2", D(2020, 3, 5)), ("b", "I21", D(2020, 1, 1))], "id string, icd string, date date")


def test_rules_by_alias_and_list(spark, icd):
    e = Engine(spark)
    got = e.predict(["af", "myocardial_infarction_icd"], icd=icd)
    assert set(got) == {"af", "myocardial_infarction_icd"}
    assert got["af"].columns[0] == "note_idx" and [r["time_diff"] for r in got["af"].collect()] == [64]
    assert [r["id"] for r in got["myocardial_infarction_icd"].collect()] == ["b"]
    assert e.predict("mi", icd=icd, return_features=True)[0] is None


def test_errors_come_together(spark, icd):
    e = Engine(spark)
    with pytest.raises(ValueError, match="needs the tables"):
        e.predict("cad", icd=icd)
    with pytest.raises(schema.SchemaError, match=r"reserved.*missing columns"):
        e.predict("af", icd=icd.withColumnRenamed("date", "note_idx"))
    with pytest.raises(schema.SchemaError, match="1 nulls"):
        e.predict("af", icd=icd.unionByName(spark.createDataFrame([(None, "x", None)], icd.schema)))
    with pytest.raises(ValueError, match="unknown phenotype"):
        e.predict("nothing", icd=icd)
    cast = icd.selectExpr("id", "icd", "cast(date as string) as date", "1 as more")
    with pytest.raises(schema.SchemaError):
        e.predict("mi", icd=cast)
    assert e.predict("mi", icd=cast, force_casting=True).count() == 1


def test_registry():
    r = Registry()
    assert r.is_valid("af") and not r.is_valid("zz") and "cad" in r.all_names() and "cad" not in r.all_names(aliases=False)
    assert r.info("af")["aliases"] == ["af"] and r.info("af")["credits"]
    with pytest.raises(ValueError):
        r.register_alias("x", "zz")


def test_keyword_phenotype_end_to_end(spark, icd, tmp_path):
    path = tmp_path / "k.yaml"
    path.write_text(KEYWORDS)
    e = Engine(spark)
    e.register(str(path))
    note = spark.createDataFrame([("a", "Tremor of the hands. No falls.", D(2020, 2, 1)), ("b", "He was struck on the head.", D(2020, 3, 1)), ("c", None, D(2020, 3, 1))], "id string, note string, date date")
    f, p = e.predict("sh", {"icd": icd, "note": note}, return_features=True)
    rows = {r["id"]: r for r in f.collect()}
    assert len(rows) == 3 and rows["a"]["i48"] == 1 and rows["a"]["hand_tremor_"] == 1 and rows["a"]["fall_neg_"] == 1 and rows["b"]["hit_strike_"] == 1 and rows["c"]["fall_"] == 0
    assert {r["id"]: r["prediction"] for r in p.collect()} == {"a": 1, "b": 0, "c": 0}
    truth = spark.createDataFrame([("a", D(2020, 2, 1), 1), ("b", D(2020, 3, 1), 0)], "id string, date date, actual int")
    m = e.evaluate("sh", truth, {"icd": icd, "note": note}).first()
    assert (m["n"], m["accuracy"], m["roc_auc"]) == (2, 1.0, 1.0)
    done = e.save_predictions({"sh": (f, p)}, str(tmp_path / "out"))
    assert [spark.read.parquet(x).count() for x in done] == [3, 3]
    assert e.save_predictions(p, str(tmp_path / "one"))[0].endswith("output/predictions.parquet")
    assert "shaky" in e.find_compatible_models({"icd": icd, "note": note}) and "shaky" not in e.find_compatible_models({"icd": icd})


def test_scale_is_clipped_and_overridden(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text(SCALE)
    e = Engine(spark)
    e.register(str(path))
    note = spark.createDataFrame([("a", "Weak arm"), ("b", "fine"), ("c", "weak, rankin 2")], "id string, note string")
    assert {r["id"]: r["score"] for r in e.predict("scale", note=note).collect()} == {"a": 42.0, "b": 0.0, "c": 2.0}


def test_sources_round_trip(spark, icd, tmp_path):
    tables.write(icd, str(tmp_path / "x_icd.parquet"))
    assert set(tables.read_roles(spark, str(tmp_path), "x")) == {"icd"}
    with pytest.raises(ValueError):
        tables.read_roles(spark, str(tmp_path), "y")
    text = spark.createDataFrame([('a "quoted", line\nbreak', 1)], "t string, n int")
    tables.write(text, str(tmp_path / "c"), "csv")
    assert tables.read_csv(spark, str(tmp_path / "c"), "t string, n int").collect() == text.collect()
    tables.write(text, str(tmp_path / "j"), "json")
    assert tables.read_parquet(spark, str(tmp_path / "x_icd.parquet"), str(tmp_path / "x_icd.parquet")).count() == 6
    (tmp_path / "m.json").write_text('{"a": {"b": [1, 2]}}')
    assert tables.read_json(spark, str(tmp_path / "m.json")).first()["a"]["b"] == [1, 2]


def test_two_codes_over_a_stream(spark, icd, tmp_path):
    src = tmp_path / "in"
    icd.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(icd.schema).parquet(str(src))
    q = scoring.two_codes_stream(stream, ["^I48"]).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["id"], r["time_diff"]) for r in spark.table("pairs").collect()] == [("a", 64)]


def test_notes_stream_meets_codes(spark, icd, tmp_path):
    note = spark.createDataFrame([("a", D(2020, 2, 1))], "id string, date date")
    note.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(note.schema).parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    out = scoring.notes_with_codes(stream, icd, {"af": F.col("icd").rlike("^I48")}, "6mo", "6mo")
    q = out.writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("met").selectExpr("sum(af)").first()[0] == 2


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    from datetime import datetime

    T = lambda m: datetime(2024, 1, 1, 0, m)
    schema_ = "at timestamp, k string"
    for i, rows in enumerate([[(T(1), "a"), (T(2), "a"), (T(30), "b")], [(T(3), "a"), (T(45), "b")], [(T(59), "b")]]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = scoring.counts_by_window(spark.readStream.schema(schema_).parquet(str(tmp_path / "in")), "at", "5 minutes", "10 minutes", "k")
        q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, i
    got = {(r["start"].minute, r["k"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[(0, "a")] == 2 and got[(30, "b")] == 1


KINDS_OF_TEXT = """name: mixed
kind: keywords
inputs:
  note: {id: string, note: string, date: date}
  icd: {id: string, icd: string, date: date}
  med: {id: string, med: string, date: date}
  demo: {id: string, date_of_birth: date, sex: string}
params:
  window: {icd: 6mo, med: -2y}
  undated: true
  demo: true
  per_day: true
  negation: windowed
  unstemmed: [parkinsonism]
  icd: {ordered: {heart: '^I4', vessel: '^I'}, total: n_icds, total_of: [heart]}
  med: {ordered: {statin: 'statin$'}, names: [statin, aspirin], else_text: true, total: n_meds}
  keywords: [parkinsonism, tremor]
  weights: {heart: 1.0, tremor_neg_: -2.0}
"""


def test_blocks_of_every_kind(spark, icd, tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text(KINDS_OF_TEXT)
    e = Engine(spark)
    e.register(str(path))
    note = spark.createDataFrame([("a", "No tremor now.", D(2020, 2, 1)), ("a", "Parkinsonism remains.", D(2020, 2, 1)), ("b", "Tremor.", D(2020, 2, 1)), ("c", "x", D(2020, 2, 1))], "id string, note string, date date")
    med = spark.createDataFrame([("a", "Aspirin", D(2019, 1, 1)), ("a", "Pravastatin", D(2020, 3, 1)), ("b", "Simvastatin", D(2018, 2, 1))], "id string, med string, date date")
    demo = spark.createDataFrame([("a", D(1950, 1, 1), "m"), ("b", D(1960, 1, 1), None), ("b", D(1960, 1, 1), None), ("c", D(1960, 1, 1), "F")], "id string, date_of_birth date, sex string")
    f, p = e.predict("mixed", {"note": note, "icd": icd, "med": med, "demo": demo}, return_features=True)
    rows = {r["id"]: r.asDict() for r in f.collect()}
    assert set(rows) == {"a", "c"}  # b lacks a sex
    want = {"heart": 1, "vessel": 0, "n_icds": 1, "statin": 0, "aspirin": 1, "n_meds": 1, "parkinsonism_": 1, "tremor_": 0, "tremor_neg_": 1, "age": 70, "sex": 1}
    assert {k: rows["a"][k] for k in want} == want
    assert {r["id"]: r["prediction"] for r in p.collect()} == {"a": 0, "c": 0}


@pytest.mark.parametrize(("params", "want"), [
    ("kind: counts\nparams: {ngrams: [fall], weights: {fall_: 1.0}, bias: -0.5}", {"a": 1, "b": 0}),
    ("kind: counts\nparams: {cleaning: content, stop: [the], keep: [ad], ngrams: [fall], weights: {fall_: 1.0}, bias: -1.5}", {"a": 1, "b": 0}),
    ("kind: patterns\nparams: {on: stems, patterns: {f: 'fall.*fall'}, weights: {f_: 1.0}, bias: -0.5}", {"a": 1, "b": 0}),
    ("kind: patterns\nparams: {patterns: ['fall'], weights: {fall_: 1.0}, threshold: 0.5, inclusive: true}", {"a": 1, "b": 1}),
    ("kind: patterns\nparams: {patterns: ['fall'], weights: {fall_: 1.0}, stated_grades: true, poor: 2}", {"a": 1, "b": 1}),
])
def test_kinds_of_text(spark, tmp_path, params, want):
    path = tmp_path / "k.yaml"
    path.write_text("name: k\ninputs: {note: {id: string, note: string}}\n" + params)
    e = Engine(spark)
    e.register(str(path))
    note = spark.createDataFrame([("a", "Falls again: fall."), ("b", "rankin 2")], "id string, note string")
    assert {r["id"]: r["prediction"] for r in e.predict("k", note=note).collect()} == want


def test_booster_and_saved_models(spark, tmp_path, quick_fits):
    import json

    (tmp_path / "b.json").write_text(json.dumps([{"nodeid": 0, "split": "fall_", "split_condition": 1, "yes": 1, "no": 2, "missing": 1, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 2.0}]}]))
    path = tmp_path / "k.yaml"
    path.write_text(f"name: k\nkind: counts\ninputs: {{note: {{id: string, note: string}}}}\nparams: {{ngrams: [fall, mri], booster: '{tmp_path / 'b.json'}', features: [mri_, fall_]}}")
    e = Engine(spark)
    e.register(str(path))
    note = spark.createDataFrame([("a", "fall"), ("b", "mri"), ("c", None)], "id string, note string")
    assert {r["id"]: r["prediction"] for r in e.predict("k", note=note).collect()} == {"a": 1, "b": 0, "c": 0}
    # a pipeline is loaded once
    from phenoframe.operators import compare

    f = spark.createDataFrame([(i, i % 2, i % 2, 0) for i in range(40)], "key int, label int, fall_ int, mri_ int")
    tables.save_model(compare.search(f, ["fall_", "mri_"], "logistic", k=2)[0], str(tmp_path / "m"))
    path.write_text(f"name: k\nkind: counts\ninputs: {{note: {{id: string, note: string}}}}\nparams: {{ngrams: [fall, mri], pipeline: '{tmp_path / 'm'}'}}")
    e.register(str(path))
    assert {r["id"]: r["prediction"] for r in e.predict("k", note=note).collect()} == {"a": 1, "b": 0, "c": 0}
    first = e._models[str(tmp_path / "m")]
    e.predict("k", note=note)
    assert e._models[str(tmp_path / "m")] is first


def test_tables_without_rows_and_models(spark, icd):
    e = Engine(spark)
    with pytest.raises(ValueError, match="no rows"):
        e.predict("mi", icd=icd.limit(0))
    assert Engine(spark, strict=False).predict("mi", icd=icd.limit(0)).count() == 0
    note = spark.createDataFrame([("a", "Tremor, no falls.", D(2020, 2, 1))], "id string, note string, date date")
    with pytest.raises(ValueError, match="no model"):
        e.predict("wlst", note=note)
    with pytest.raises(ValueError):
        e.features("mi", icd=icd)
    made, predictions = e.predict("af", icd=icd, return_features=True)
    assert made is predictions and e.predict("mi", icd=icd, return_features=True)[0] is None


def test_bundled_features(spark, icd):
    e = Engine(spark)
    note = spark.createDataFrame([("a", "History of subdural hematoma. Not struck on the head.", D(2020, 2, 1)), ("b", "No tremor. Comfort measures only.", D(2020, 2, 1))], "id string, note string, date date")
    cpt = spark.createDataFrame([("a", "70450", D(2020, 1, 1))], "id string, cpt string, date date")
    med = spark.createDataFrame([("b", "Sinemet CR", D(2020, 1, 1))], "id string, med string, date date")
    data = {"note": note, "icd": icd, "cpt": cpt, "med": med}
    got = {n: {r["id"]: r.asDict() for r in e.features(n, data).collect()} for n in ("sdh", "tbi", "pd", "wlst", "mci")}
    a = got["sdh"]["a"]
    assert (a["sdh_"], a["sdh_hist_"], a["mri"], a["ct"], got["sdh"]["b"]["mri"]) == (1, 1, 1, 0, 0)
    assert (got["tbi"]["a"]["custom_hit_strike_"], got["tbi"]["a"]["custom_hit_strike_neg_"]) == (0, 1)
    assert (got["pd"]["b"]["tremor_"], got["pd"]["b"]["tremor_neg_"], got["pd"]["b"]["sinemet"]) == (0, 1, 1)
    assert got["wlst"]["b"]["comfort_measures_"] == 1 and got["wlst"]["a"]["comfort_measures_"] == 0
    assert got["mci"]["a"]["icd"] == 0


def test_command_lines(spark, icd, tmp_path, quick_fits):
    from phenoframe import cli

    tables.write(icd, str(tmp_path / "data" / "run_icd.parquet"))
    cli.main(["predict", "--data-dir", str(tmp_path / "data"), "--prefix", "run", "--output", str(tmp_path / "out"), "--show-progress"], spark)
    assert spark.read.parquet(str(tmp_path / "out/myocardial_infarction_icd/predictions.parquet")).count() == 1
    rows = [(i, i % 2, float(i % 7), int(i % 10 < 4 + 3 * (i % 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "source int, x int, z double, annot int").withColumn("source", F.col("source") % 2).withColumn("drop", F.lit("u")).coalesce(1)
    tables.write(df, str(tmp_path / "t"))
    args = ["compare", "--input", str(tmp_path / "t"), "--drop_columns", "drop", "--n_folds", "2", "--families", "logistic"]
    cli.main([*args, "--output_dir", str(tmp_path / "by_source")], spark)
    assert tables.read_csv(spark, str(tmp_path / "by_source/leave_one_out_results")).count() == 2 and tables.load_model(str(tmp_path / "by_source/final_model")).transform
