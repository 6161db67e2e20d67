from datetime import datetime

from phenoframe.operators import eventfeatures as ef

T = datetime(2024, 1, 10, 12)


def tables(spark):
    icd = spark.createDataFrame(
        [
            (1, "p", T, "i63.2", 1.25, T), (1, "p", T, "I63.2", 2.5, datetime(2024, 2, 1)), (2, "p", datetime(2024, 1, 5), "I632", -0.5, T), (3, "p", None, "I63.2", None, T), (4, "q", T, "unknown", 9.0, T),
            (5, None, T, "I63.2", 1.0, T), (6, "r", T, None, 1.0, T), (None, "p", T, "I63.2", 5.0, T),
        ],
        "icd_id long, patient_id string, icd_date timestamp_ntz, icd_code string, charge double, loaded_at timestamp_ntz",
    )
    med = spark.createDataFrame([(1, "p", datetime(2024, 1, 9), T), (1, "p", datetime(2024, 1, 9), T), (2, "s", None, T)], "med_id long, patient_id string, med_date timestamp_ntz, loaded_at timestamp_ntz")
    codes = spark.createDataFrame([(1, "I63.2"), (2, "G20"), (3, "i63.2"), (4, None)], "code_id int, icd_code string")
    return icd, med, codes


def test_features(spark):
    got = {r["patient_id"]: r for r in ef.coded_features(*tables(spark)).collect()}
    assert set(got) == {"p", "q", "r", "s"}
    p = got["p"]
    assert (p["n_i63_2"], p["days_i63_2"], p["total_i63_2"]) == (3, 0, 2.0)
    assert (p["n_g20"], p["days_g20"], p["total_g20"]) == (0, None, 0.0)
    assert (p["n_med"], p["days_med"]) == (1, 1)
    assert (got["s"]["n_med"], got["s"]["days_med"], got["q"]["n_i63_2"]) == (1, None, 0)


def test_as_of_and_empty(spark):
    icd, med, codes = tables(spark)
    assert {r["patient_id"]: r["days_i63_2"] for r in ef.coded_features(icd, med, codes, as_of="2024-01-20").collect()}["p"] == 10
    assert ef.coded_features(icd.limit(0), med.limit(0), codes).count() == 0


def test_hot_entity_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(ef, "COMBINE", 10)
    e = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('e', id % 97)) as entity", "cast(id % 5 as int) as type", "date_add(date'2024-01-01', cast(id % 30 as int)) as day", "id % 7 - 2.5 as amount")
    got = {r["entity"]: r for r in ef.wide_features(e, list("abcde"), "2024-02-01").collect()}
    want = {(r["entity"], r["type"]): r for r in e.groupBy("entity", "type").agg({"*": "count", "amount": "sum", "day": "max"}).collect()}
    assert len(got) == 98
    for (ent, t), w in want.items():
        c = "abcde"[t]
        assert got[ent][f"n_{c}"] == w["count(1)"] and abs(got[ent][f"total_{c}"] - float(w["sum(amount)"])) < 1e-6
