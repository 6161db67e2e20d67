import calendar
from datetime import date

import pytest
from pyspark.sql import functions as F

from phenoframe.operators import codes, rules, temporal, timeline
from phenoframe.plans import coded, shapes

D = date


def test_window_is_inclusive_and_clamps_at_month_ends(spark):
    notes = spark.createDataFrame([("p", D(2024, 2, 28)), ("p", D(2024, 2, 29)), ("p", D(2025, 2, 28)), ("p", D(2025, 3, 1))], "id string, date date")
    events = spark.createDataFrame([("p", D(2024, 8, 31), "x"), ("q", D(2024, 8, 31), "x")], "id string, date date, icd string")
    got = {r["date"] for r in temporal.in_window(notes, events, "6mo", "6mo").collect()}
    assert got == {D(2024, 2, 29), D(2025, 2, 28)}


def test_month_end_query_pairs_all_rows(spark, tmp_path):
    """Three days at a month's end, a date far from it, and a key with many rows, against every pair of rows."""
    days = [D(2024, 2, 28), D(2024, 2, 29), D(2024, 3, 1), D(2020, 5, 5), D(2020, 11, 5), D(2020, 11, 6)]
    notes = [(i, "hot" if i % 2 else f"p{i % 6}", str(days[i % 6]), "x") for i in range(60)] + [(90, None, "2024-02-29", "x"), (91, "hot", None, "x")]
    at = [D(2024, 8, 29), D(2024, 8, 30), D(2024, 8, 31), D(2020, 5, 5), D(2021, 5, 5)]
    codes_ = [(i, "hot" if i % 2 else f"p{i % 6}", str(at[i % 5]), "I63") for i in range(60)] + [(90, None, "2024-08-31", "I63"), (91, "hot", None, "I63")]
    spark.createDataFrame([*notes, notes[0]], "visit_id long, patient_id string, note_date string, note_text string").write.parquet(str(tmp_path / "note.parquet"))
    spark.createDataFrame([*codes_, codes_[0]], "icd_id long, patient_id string, icd_date string, icd_code string").write.parquet(str(tmp_path / "icd.parquet"))

    def moved(d, months):
        y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
        return D(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))

    want = [(a, b, x) for a, p, x, _ in notes for b, q, y, _ in codes_ if p and x and y and p == q and moved(D.fromisoformat(y), -6) <= D.fromisoformat(x) <= moved(D.fromisoformat(y), 6)]
    got = [tuple(r) for r in coded.query.queries["interval_join_month_end"](spark, str(tmp_path)).select("a", "b", "date").collect()]
    assert want and sorted(got) == sorted(want)


def test_month_end_query_casts_no_date_per_pair(spark, tmp_path):
    spark.createDataFrame([(1, "p", "2024-02-29", "x")], "visit_id long, patient_id string, note_date string, note_text string").write.parquet(str(tmp_path / "note.parquet"))
    spark.createDataFrame([(2, "p", "2024-08-31", "I63")], "icd_id long, patient_id string, icd_date string, icd_code string").write.parquet(str(tmp_path / "icd.parquet"))
    got = coded.query.queries["interval_join_month_end"](spark, str(tmp_path))
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert len(above) == 2 and "cast(" not in above[0]
    assert [tuple(r) for r in got.select("a", "b", "date").collect()] == [(1, 2, "2024-02-29")]


def _shuffled_rows(node):
    """Rows that the exchanges of an executed plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(node.executedPlan())
    if kind == "ReusedExchangeExec":
        return 0
    if kind.endswith("QueryStageExec"):
        return _shuffled_rows(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled_rows(node.children().apply(i)) for i in range(node.children().size()))


def test_month_end_query_shuffles_no_row_per_day(spark, tmp_path):
    """A hot patient's note meets events of many days: notes are copied to periods, not to days."""
    day = [D.fromordinal(D(2020, 1, 1).toordinal() + i) for i in range(360)]
    spark.createDataFrame([(i, "hot", str(d), "x") for i, d in enumerate(day)], "visit_id long, patient_id string, note_date string, note_text string").write.parquet(str(tmp_path / "note.parquet"))
    spark.createDataFrame([(i, "hot", str(d), "I63") for i, d in enumerate(day)], "icd_id long, patient_id string, icd_date string, icd_code string").write.parquet(str(tmp_path / "icd.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        got = coded.query.queries["interval_join_month_end"](spark, str(tmp_path))
        assert len(got.collect()) > 90_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < _shuffled_rows(got._jdf.queryExecution().executedPlan()) < 8 * 2 * len(day)


def test_rows_meet_once_in_tiles(spark, monkeypatch):
    """Periods cut into many tiles, periods that share a slot of the table of counts, repeated rows on both sides, undated ones, against in_window."""
    monkeypatch.setattr(temporal, "TILE", {"_s": 3, "_e": 2})
    monkeypatch.setattr(temporal, "SLOTS", 5)
    day = lambda i: D.fromordinal(D(2019, 11, 1).toordinal() + i * 37 % 900)
    notes = [(i, ("hot", "hot", "p", "q")[i % 4], day(i)) for i in range(80)] + [(200, "hot", None), (201, None, day(1))]
    events = [(i, ("hot", "p", "hot", "r")[i % 4], day(3 * i)) for i in range(90)] + [(200, "hot", None), (201, None, day(1))]
    s, e = spark.createDataFrame(notes, "a long, id string, date date"), spark.createDataFrame(events, "b long, id string, date date")
    want = sorted(tuple(r) for r in temporal.in_window(s, e, "6mo", "3mo").select("a", "id", "date", "b").collect())
    text = {"text": F.col("date").cast("string")}
    got = sorted(tuple(r) for r in temporal.rows_in_window(s.union(s), e.union(e).union(e), "6mo", "3mo", more=text).select("a", "id", "date", "b", "text").collect())
    assert len(want) > 300 and got == [(*w, str(w[2])) for w in want]


def test_nulls_last_query_places_all_rows(spark, tmp_path):
    rows = [(i * 37 % 101, (None, 1, 0)[i % 3]) for i in range(101)]
    spark.createDataFrame(rows, "note_id long, annot int").repartition(3).write.parquet(str(tmp_path / "notes.parquet"))
    got = {r["place"]: r["note_id"] for r in shapes.query.queries["nulls_last_sort"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(1, 102)] == [n for n, a in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]


def test_lookback_counts_both_ends(spark):
    notes = spark.createDataFrame([("p", D(2024, 2, 29))], "id string, date date")
    events = spark.createDataFrame([("p", d, i) for i, d in enumerate([D(2022, 2, 28), D(2022, 2, 27), D(2024, 2, 29), D(2024, 3, 1)])], "id string, date date, n int")
    assert {r["n"] for r in temporal.looked_back(notes, events, "2y").collect()} == {0, 2}


def test_every_spine_row_stays_once_with_zeros(spark):
    spine = spark.createDataFrame([(1, "p", D(2020, 1, 1)), (2, "p", D(2020, 1, 1)), (3, "q", D(2020, 1, 1))], "idx int, id string, date date")
    events = spark.createDataFrame([("p", D(2020, 2, 1), "I63.1"), ("p", D(2020, 2, 1), "I63.2"), ("z", D(2020, 1, 1), "I63")], "id string, date date, icd string")
    got = temporal.windowed_features(spine, events, "6mo", "6mo", {"stroke": F.col("icd").rlike("^I63"), "other": F.col("icd").rlike("^G")})
    assert sorted((r["idx"], r["stroke"], r["other"]) for r in got.collect()) == [(1, 1, 0), (2, 1, 0), (3, 0, 0)]


def test_null_safe_and_one_to_one_joins(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("y", 30)], "k string, b int")
    assert sorted(r["b"] for r in temporal.null_safe(a, b, ["k"]).collect()) == [10, 20]
    with pytest.raises(ValueError, match="repeats"):
        temporal.one_to_one(a, b.unionByName(b), ["k"])
    with pytest.raises(ValueError, match="no key"):
        temporal.common_keys(a, b)


def test_demographics_need_one_row_a_person(spark):
    spine = spark.createDataFrame([("p", D(2024, 1, 1)), ("q", D(2024, 1, 1)), ("r", D(2024, 1, 1))], "id string, date date")
    demo = spark.createDataFrame([("p", D(2000, 12, 31), "M"), ("p", D(2000, 12, 31), "M"), ("q", None, None)], "id string, date_of_birth date, sex string")
    got = {r["id"]: (r["age"], r["sex"]) for r in temporal.demographics(spine, demo).collect()}
    assert got == {"p": (24, 1), "q": (None, None), "r": (None, None)}
    with pytest.raises(ValueError, match="differing"):
        temporal.demographics(spine, demo.unionByName(spark.createDataFrame([("p", None, "F")], demo.schema)))


def test_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = temporal.numbered(df, "k").collect()
    assert sorted(r["note_idx"] for r in got) == list(range(1000))
    assert all(r["note_idx"] == r["k"] for r in got)
    assert temporal.numbered(df.limit(0), "k").count() == 0


def test_texts_of_a_day_keep_their_order(spark):
    df = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, None), ("p", 4, "")], "id string, i int, note string")
    assert [tuple(r) for r in temporal.texts_of_day(df, ["id"], "note", "i").collect()] == [("p", 1, "a b ")]


def test_two_codes_take_consecutive_pairs(spark):
    days = [0, 3, 12, 20, 385, 751]
    rows = [("p", "I48", date.fromordinal(D(2020, 1, 1).toordinal() + d)) for d in days] + [("q", "I48", D(2020, 1, 1)), ("q", "I48", D(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id string, icd string, date date")
    got = rules.two_codes(df, "icd", ["^I48"])
    assert sorted(r["time_diff"] for r in got.collect()) == [8, 9, 365]


def test_union_of_codes_with_an_empty_table(spark):
    icd = spark.createDataFrame([("p", "I25.1", 1)], "id string, icd string, extra int")
    cpt = spark.createDataFrame([], "id string, cpt string")
    got = rules.union_codes([(icd, "icd", ["^I25"], "icd"), (cpt, "cpt", ["929"], "cpt")]).collect()
    assert [(r["code"], r["code_type"], r["extra"], r["prediction"]) for r in got] == [("I25.1", "icd", 1, 1)]


def test_grouping_takes_the_first_match(spark):
    df = spark.createDataFrame([("R56.9",), ("R569",), ("R56.1",), ("780.39",), ("R55",), (None,)], "icd string")
    g = codes.first_group("icd", {"epilepsy": r"^R56\.?9|^G40", "convulsions": r"^R56.*|^780\.?3", "syncope": "^R55"})
    assert [r[0] for r in df.select(g).collect()] == ["epilepsy", "epilepsy", "convulsions", "convulsions", "syncope", None]


def test_one_hot_has_names_that_never_occur(spark):
    df = spark.createDataFrame([("p", "a"), ("p", None), ("q", "z")], "id string, x string")
    got = {r["id"]: (r["a"], r["b_c"]) for r in codes.one_hot(df, ["id"], "x", ["a", "b c"]).collect()}
    assert got == {"p": (1, 0), "q": (0, 0)}


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a[b]` int, c int")
    assert codes.safe_names(df).columns == ["a_b_", "c"]
    assert codes.suffixed(df, "_", ["c"]).columns == ["a[b]_", "c"]


def test_timeline_ends_with_the_least_date(spark):
    ev = spark.createDataFrame([("p", "a", D(2020, 1, 1)), ("p", "b", D(2020, 6, 1)), ("q", "a", D(2020, 1, 1))], "id string, state string, start_date date")
    death = spark.createDataFrame([("p", D(2020, 3, 1))], "id string, died date")
    got = {(r["id"], r["state"]): r["end_date"] for r in timeline.spans(ev, [death]).collect()}
    assert got == {("p", "a"): D(2020, 3, 1), ("p", "b"): D(2020, 3, 1), ("q", "a"): None}


def test_next_row_of_a_key_over_many_slices(spark):
    rows = [("hot", i * 3 % 1000, i) for i in range(700)] + [(f"k{i % 40}", i, i) for i in range(200)] + [(None, 5, 1), (None, 9, 2)]
    df = spark.createDataFrame(rows, "id string, date int, n int").repartition(5)
    got = {(r["id"], r["date"], r["n"]): r["next_date"] for r in temporal.with_next(df, "id", "date", "n").collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        assert [got[r] for r in own] == [r[1] for r in own[1:]] + [None]


def test_lookback_features(spark):
    spine = spark.createDataFrame([(1, "p", D(2024, 2, 29)), (2, "q", D(2024, 1, 1))], "idx int, id string, date date")
    events = spark.createDataFrame([("p", D(2022, 2, 28), "a"), ("p", D(2024, 3, 1), "b"), ("p", D(2022, 2, 27), "c")], "id string, date date, m string")
    got = {r["idx"]: (r["a"], r["b"], r["c"]) for r in temporal.lookback_features(spine, events, "2y", {x: F.col("m") == x for x in "abc"}).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 0, 0)}


def test_undated_rows_meet_all_events_of_their_key(spark):
    notes = spark.createDataFrame([(1, "p", D(2024, 1, 1)), (2, "p", None), (3, "q", None), (4, "p", D(2020, 1, 1))], "i int, id string, date date")
    events = spark.createDataFrame([("p", D(2024, 2, 1), "x"), ("p", D(2019, 1, 1), "y"), (None, D(2019, 1, 1), "y")], "id string, date date, c string")
    tests = {"x": F.col("c") == "x", "y": F.col("c") == "y"}
    for undated, want in ((True, [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0)]), (False, [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)])):
        got = temporal.windowed_features(notes, events, "6mo", "6mo", tests, undated=undated)
        assert sorted((r["i"], r["x"], r["y"]) for r in got.collect()) == want
    assert sorted((r["i"], r["x"], r["y"]) for r in temporal.lookback_features(notes, events, "1y", tests, undated=True).collect()) == [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1)]


def test_join_over_keys_of_other_names(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(1, "x", 5), (2, "q", 6), (None, "z", 7)], "i int, v string, w int")
    assert {(r["k"], r["v"], r["w"]) for r in temporal.renamed_join(a, b, {"k": "i", "v": "v"}).collect()} == {(1, "x", 5), (2, "y", None), (None, "z", None)}


def test_signs_of_a_pattern_are_spelt_out(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["\\bno\\s", "a|b[c]?", "plain"])
    assert codes.spelt_names(df).columns == ["_B_no_S_", "a_OR_b_LB_c_RB__Q_", "plain"]


def test_demographic_rows_that_differ_are_an_error(spark):
    spine = spark.createDataFrame([("p", D(2024, 1, 1))], "id string, date date")
    rows = [("p", D(1950, 1, 1), "Male"), ("p", D(1950, 1, 1), "Male")]
    got = temporal.demographics(spine, spark.createDataFrame(rows, "id string, date_of_birth date, sex string")).first()
    assert (got["age"], got["sex"]) == (74, 1)
    with pytest.raises(ValueError):
        temporal.demographics(spine, spark.createDataFrame([*rows, ("p", D(1950, 1, 1), "F")], "id string, date_of_birth date, sex string"))
