"""Splits, components, near-duplicates and the nearest-in-time join."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import components, nearest, neardup, splits

NOTES = "note_id long, hospital string, bdsp_patient_id string, note string"


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)],
    [(0, i) for i in range(1, 200)] + [(500 + i, 501 + i) for i in range(0, 20, 2)],
    [],
])
def test_hash_to_min(spark, edges):
    df = spark.createDataFrame([*edges, (None, 5), (6, None)] if edges else [], "a long, b long")
    got = {r["node"]: r["component"] for r in components.hash_to_min(df, "a", "b").collect()}
    assert got == brute_components(edges)


def test_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(120)]
    assert {x["node"]: x["component"] for x in components.hash_to_min(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()} == brute_components(edges)


def test_keys_of_patients_and_sites(spark):
    p = ["700-001-255", " 0700001255", "700001255.0", "0", "-", "", None, "unknown", "000.0"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in p], "x string").select(splits.patient_key("x")).collect()] == ["700001255"] * 3 + [None] * 6
    s = ["s-0000029", "S 0000029 ", "S0000029", "N/A", "other", "S0000000", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in s], "x string").select(splits.site_key("x")).collect()] == ["S0000029"] * 3 + [None] * 4


def test_linked_sites(spark):
    rows = [(1, "S0000001", "10"), (2, "s-0000002", "010"), (3, "S0000002", "11"), (4, "S0000003", "11.0"), (5, "S0000004", "12"), (6, None, "12"), (7, "S0000005", "-"), (8, "S0000006", "-"), (9, "other", "13")]
    df = spark.createDataFrame([(*r, "x") for r in rows], NOTES)
    got = {tuple(r) for r in splits.linked_sites(df, "bdsp_patient_id", "hospital").collect()}
    assert got == {("S0000001", "S0000002"), ("S0000001", "S0000003"), ("S0000002", "S0000003")}
    assert splits.linked_sites(df.limit(0), "bdsp_patient_id", "hospital").count() == 0


def test_split_keeps_linked_records_and_shares(spark):
    r = random.Random(2)
    rows = [(i, f"S{r.randrange(1, 900):07d}", str(r.randrange(1, 3000)) if i % 3 else None, "x") for i in range(3000)]
    rows += [(5000 + i, "S0009999", None, "x") for i in range(400)] + [(9000, None, None, "x"), (9001, None, None, None)]
    df = spark.createDataFrame(rows, NOTES).withColumn("split_name", F.lit("clash"))
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, share double")
    got = splits.grouped_split(df, "note_id", "bdsp_patient_id", "hospital", t)
    per = got.groupBy("component").agg(F.count_distinct("split_name").alias("k")).agg(F.max("k")).first()[0]
    assert got.count() == len(rows) and per == 1
    again = {r["note_id"]: r["split_name"] for r in splits.grouped_split(df.repartition(3), "note_id", "bdsp_patient_id", "hospital", t).collect()}
    assert again == {r["note_id"]: r["split_name"] for r in got.collect()}
    small = spark.createDataFrame([(i, None, str(i), "x") for i in range(4000)], NOTES)
    rep = {r["split_name"]: r["reached"] for r in splits.split_report(splits.grouped_split(small, "note_id", "bdsp_patient_id", "hospital", t), t.where("split_name is not null")).collect()}
    assert abs(rep["train"] - 0.8) < 0.03 and abs(rep["test"] - 0.1) < 0.03
    with pytest.raises(ValueError):
        splits.grouped_split(df, "note_id", "bdsp_patient_id", "hospital", t.limit(0))


def texts(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(25, 60))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        out.append((k, " ".join(w)))
    return out


def brute_pairs(rows, run, t, least):
    sets = {}
    for i, x in rows:
        if i is None or not x:
            continue
        w = "".join(c for c in x.lower() if c.isalpha() or c.isdigit() or c.isspace()).split()
        if len(w) >= max(least, run):
            sets[i] = frozenset(tuple(w[k : k + run]) for k in range(len(w) - run + 1))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize(("t", "tile"), [(0.6, 8192), (0.8, 8192), (0.6, 5)])
def test_near_pairs_are_exact(spark, monkeypatch, t, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = [*texts(int(t * 10), 160), (900, None), (901, ""), (902, "one two"), (None, "a b c " * 20), (903, "same words " * 30), (904, "Same, words! " * 30), (903, "same words " * 30)]
    df = spark.createDataFrame(rows, "note_id long, note string").withColumn("a", F.lit(1))
    got = [tuple(r) for r in neardup.near_pairs(df, "note_id", "note", run=3, t=t, least_words=20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 3, t, 20)


def test_near_groups(spark):
    rows = texts(5, 80)
    pairs = brute_pairs(rows, 3, 0.6, 20)
    want = brute_components([*pairs, *((i, i) for i, _ in rows)])
    got = {r["note_id"]: r for r in neardup.near_groups(spark.createDataFrame(rows, "note_id long, note string"), "note_id", "note", 3, 0.6, 20).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert {k: r["n_links"] for k, r in got.items()} == {k: sum(k in p for p in pairs) for k in got}  # copies count as links like all others
    assert neardup.near_groups(spark.createDataFrame([], "note_id long, note string"), "note_id", "note").count() == 0


def test_tree_prunes_only_what_cannot_match():
    r = np.random.default_rng(3)
    n_docs, t = 90, 0.6
    sets = [set(r.integers(0, 150, r.integers(30, 60)).tolist()) for _ in range(30)]
    sets = [set(s) - set(list(s)[: k % 5]) for k, s in enumerate(sets * 3)]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    tokens = np.concatenate([np.array(sorted(s), dtype=np.int64) * 2654435761 for s in sets])
    bits = neardup._bits(np.repeat(np.arange(n_docs), n), tokens, n_docs)
    slack = n - neardup._popcount(bits)
    zero = np.zeros(n_docs, dtype=np.int64)
    seen = {}
    pieces = neardup.dual_traversal(zero, zero, n, zero, np.ones(n_docs, dtype=bool), slack, bits, t, seen)
    found = {(min(a, b), max(a, b)) for i, j in pieces for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(n_docs) for b in range(a + 1, n_docs) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
    assert want <= found and len(found) < n_docs * (n_docs - 1) // 2
    assert seen["block"] == n_docs * (n_docs - 1) // 2 > seen["trees"] >= seen["prefix"] >= seen["bitmap"] == len(found)


@pytest.mark.parametrize("tile", [8192, 60])
def test_blocks_pass_on_few_pairs_that_are_not_similar(monkeypatch, tile):
    """Large sets that share words of a small vocabulary, whose bitmaps of all tokens are full: all similar pairs leave the blocks, and few of the others."""
    monkeypatch.setattr(neardup, "TILE", tile)
    r, t = np.random.default_rng(8), 0.6
    sets = [np.unique(r.integers(0, 9000, 260)) for _ in range(900)]
    sets += [np.unique(np.r_[s[20 + k :], r.integers(0, 9000, 25)]) for k, s in enumerate(sets[:60])]
    tokens = [np.sort(s.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64) for s in sets]
    counts = type("Sent", (), {"value": np.bincount(np.concatenate(tokens) % neardup.BUCKETS, minlength=neardup.BUCKETS).astype(np.int32)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([x.tolist() for x in tokens], pa.list_(pa.int64()))], names=["_doc", "_tokens"])
    rows = pa.Table.from_batches(neardup._prefix(counts, t)(iter([batch]))).sort_by([("token", "ascending"), ("part", "ascending")])
    found = {(a, b) for x in neardup._blocks(t, rows=700)(iter(rows.to_batches(500))) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)}
    has = np.zeros((len(sets), 9000), dtype=np.int32)
    for k, s in enumerate(sets):
        has[k, s] = 1
    both, n = has @ has.T, has.sum(axis=1)
    want = {(a, b) for a, b in np.argwhere(both >= t * (n[:, None] + n - both)).tolist() if a < b}
    assert len(want) >= 50 and want <= found and 20 * len(found) < len(sets) * (len(sets) - 1) // 2  # bitmaps of all tokens leave more than half of all pairs


def test_one_hot_text_in_parts(spark):
    """Copies of one text and neighbours of it, with pairs made in parts of a few rows."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(40)] + [(100 + i, " ".join([*words, f"x{i}"])) for i in range(3)]
    df = spark.createDataFrame(rows, "note_id long, note string")
    assert {tuple(r) for r in neardup.near_pairs(df, "note_id", "note", 3, 0.6, 20).collect()} == brute_pairs(rows, 3, 0.6, 20)
    groups = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1), (None, 2), ("g", None), ("g", 7)], "g string, v int")
    got = [tuple(r) for r in components.pairs_within(groups, "g", "v", rows=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(50) for b in range(a + 1, 50)}
    assert components.pairs_within(groups.limit(0), "g", "v").count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_slices_stream_in_batches_of_any_size(size):
    """The rows of a slice by batches, against the slice as one batch; a hot entity, equal times and repeated rows."""
    import pyarrow as pa

    r = random.Random(4)
    rows = sorted((("hot" if r.random() < 0.7 else f"e{r.randrange(4)}"), r.randrange(300), int(r.random() < 0.8), r.randrange(60)) for _ in range(500))

    def run(step):
        s = nearest._Slice(3, 4)
        out = []
        for i in range(0, len(rows), step):
            e, a, d, k = zip(*rows[i : i + step], strict=True)
            out += list(s.step(pa.table({"entity": pa.array(e), "at": pa.array(a, pa.int64()), "side": pa.array(d, pa.int8()), "id": pa.array(k, pa.int64())})))
            assert s.carried.num_rows < 60
        out += [*s.step(None), *s.edges()]
        return {told(x) for b in out for x in b.to_pylist()} - {None}

    def told(x):
        """A row without right records that are too far to matter, which a slice may know or not."""
        if x["kind"] == 1:
            return tuple(x.values())
        near = [x[i] if x[i] is not None and abs(x["at"] - x[a]) <= 4 else None for i, a in (("prev_id", "prev_at"), ("next_id", "next_at"))]
        return (x["entity"], x["left_id"], x["at"], *near, x["ask_prev"], x["ask_next"]) if any(v is not None for v in near) or x["ask_prev"] or x["ask_next"] else None

    assert run(size) == run(500) and len(run(size)) > 100


def test_sites_of_other_schemes_link_too(spark):
    df = spark.createDataFrame([(1, "GH-12", "7"), (2, "gh 12", "8"), (3, "K9", "8"), (4, "S000", "8"), (5, "none", "8")], "note_id long, hospital string, bdsp_patient_id string")
    assert [tuple(x) for x in splits.linked_sites(df, "bdsp_patient_id", "hospital").collect()] == [("GH12", "K9")]
    assert {tuple(x) for x in splits.site_components(df, "bdsp_patient_id", "hospital").select("hospital", "n_sites").collect()} == {("GH12", 2), ("K9", 2)}


def test_split_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"S{i:07d}", str(i), "x") for i in range(1, 400)], NOTES)
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "split_name string, share double")
    one = {r["note_id"]: r["split_name"] for r in splits.grouped_split(df.limit(200), "note_id", "bdsp_patient_id", "hospital", targets, big=2.0).collect()}
    all_ = {r["note_id"]: r["split_name"] for r in splits.grouped_split(df, "note_id", "bdsp_patient_id", "hospital", targets, big=2.0).collect()}
    assert all(all_[k] == v for k, v in one.items())  # new components move none of the old
    monkeypatch.setattr(splits, "MOST_SPLITS", 2)
    with pytest.raises(ValueError):
        splits.grouped_split(df, "note_id", "bdsp_patient_id", "hospital", targets)


def brute_nearest(left, right, hours):
    out = {}
    for i, e, t in left:
        if None in (i, e, t):
            continue
        best = min(((abs(t - u), u, k) for k, f, u in right if None not in (k, f, u) and f == e), default=None)
        if best and best[0] <= timedelta(hours=hours):
            out[i] = best[2]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest(spark, partitions):
    r = random.Random(partitions)
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(seconds=r.randrange(3_000_000))
    ent = lambda: "hot" if r.random() < 0.5 else f"e{r.randrange(12)}"
    left = [(i, ent(), at()) for i in range(600)] + [(601, None, t0), (602, "e1", None), (None, "e1", t0), (603, "lonely", t0)]
    right = [(i, ent(), at()) for i in range(80)] + [(81, None, t0), (82, "e1", None)]
    a = spark.createDataFrame([*left, left[0]], "icd_id long, p string, d timestamp_ntz").withColumn("entity", F.lit("clash"))
    b = spark.createDataFrame([*right, right[0]], "visit_id long, p string, d timestamp_ntz")
    got = nearest.nearest(a, b, "icd_id", "p", "d", "visit_id", "p", "d", 48, partitions).collect()
    assert len(got) == len({x["left_id"] for x in got})
    assert {x["left_id"]: x["right_id"] for x in got} == brute_nearest(left, right, 48)


def test_nearest_edges(spark):
    t0 = datetime(2024, 1, 3)
    a = spark.createDataFrame([(1, "p", t0), (2, "q", t0), (3, "s", t0)], "i long, p string, d timestamp_ntz")
    b = spark.createDataFrame([(10, "p", t0 - timedelta(hours=48)), (11, "q", t0 + timedelta(hours=48, microseconds=1)), (13, "s", t0), (12, "s", t0)], "v long, p string, d timestamp_ntz")
    got = {r["left_id"]: r["right_id"] for r in nearest.nearest(a, b, "i", "p", "d", "v", "p", "d", 48).collect()}
    assert got == {1: 10, 3: 12}
    assert nearest.nearest(a.limit(0), b, "i", "p", "d", "v", "p", "d", 48).count() == 0
    assert nearest.nearest(a, b.limit(0), "i", "p", "d", "v", "p", "d", 48).count() == 0
