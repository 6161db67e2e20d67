"""Splits that keep linked records together (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.components import hash_to_min, pairs_within

#: A component with at least this share of all records is placed before the others.
BIG = 0.005
#: Splits there may be.
MOST_SPLITS = 1000


def patient_key(c: Column | str) -> Column:
    """The number behind an unevenly spelt patient id, or null where it names nobody.

    A trailing .0, blanks, dashes and leading zeros don't matter; values without a digit other than zero are null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"(?U)[\s\p{Pd}_]+", ""), r"\.0*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[^0-9]", ""), r"^0+", "")
    return F.when(bare.rlike("[1-9]"), bare)


def site_key(c: Column | str) -> Column:
    """The site code behind an uneven spelling, or null where it names none: upper case without blanks, dashes and underscores.

    S and up to seven digits are written with seven; other codes stay as they are, so that sites of another scheme link too. Values without a digit other than zero are null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.upper(c.cast("string")), r"(?U)[\s\p{Pd}_]+", "")
    digits = F.regexp_extract(bare, r"^S([0-9]{1,7})$", 1)
    return F.when(bare.rlike("[1-9]"), F.when(digits != "", F.concat(F.lit("S"), F.lpad(digits, 7, "0"))).otherwise(bare))


def linked(df: DataFrame, patient: str, site: str) -> DataFrame:
    """Nodes and components (node, component) of the graph of patients (p:...) and sites (s:...)."""
    keys = df.select(F.concat(F.lit("p:"), patient_key(patient)).alias("p"), F.concat(F.lit("s:"), site_key(site)).alias("s")).distinct()
    return hash_to_min(keys.select(F.coalesce("s", "p").alias("a"), F.coalesce("p", "s").alias("b")), "a", "b")


def site_components(df: DataFrame, patient: str, site: str) -> DataFrame:
    """Each site with its component and how many sites that has: hospital, component, n_sites. The form without pairs."""
    at = linked(df, patient, site).where(F.col("node").startswith("s:")).select(F.expr("substring(node, 3)").alias("hospital"), "component")
    return at.join(at.groupBy("component").agg(F.count(F.lit(1)).alias("n_sites")), "component").select("hospital", "component", "n_sites")


def linked_sites(df: DataFrame, patient: str, site: str) -> DataFrame:
    """Each pair of sites in one component, smaller code first: hospital_a, hospital_b.

    The pairs are the result asked for; they are made from distinct sites, never from records, and a component of many sites in many tasks.
    """
    at = linked(df, patient, site).where(F.col("node").startswith("s:")).select(F.expr("substring(node, 3)").alias("h"), "component")
    return pairs_within(at, "component", "h").select(F.col("a").alias("hospital_a"), F.col("b").alias("hospital_b"))


def _score(component: Column, split: str, weight: float, seed: int) -> Column:
    """Weighted rendezvous: -w / ln(u), u uniform from the hash of component and split; the largest wins."""
    u = (F.pmod(F.xxhash64(component, F.lit(split), F.lit(seed)), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / float(1 << 52)
    return F.lit(float(weight)) / -F.log(u)


def _choice(component: Column, weights: dict[str, float], seed: int) -> Column:
    """argmax over splits, as a chain of conditions."""
    items = sorted(weights.items())
    out, top = F.lit(items[0][0]), _score(component, *items[0], seed)
    for s, w in items[1:]:
        x = _score(component, s, w, seed)
        out, top = F.when(x > top, F.lit(s)).otherwise(out), F.greatest(top, x)
    return out


def grouped_split(df: DataFrame, record: str, patient: str, site: str, targets: DataFrame, split: str = "split_name", share: str = "share", seed: int = 17, big: float = BIG) -> DataFrame:
    """One split for each record such that records linked over patients and sites share it: record, component, split_name.

    Components come from hash-to-min; weighted rendezvous hashing gives each component its split. A component that holds a share `big` or more of all records is placed first,
    largest first, by rendezvous among the splits that still have room for it (else the one with most room); the rest then draw
    with the room that is left as weights, which brings the shares near the targets even if one component holds a third of all records. So what a component gets depends on its
    name and on the components above `big`: as long as these keep their sizes, a new one moves none of the old. With big above 1 all draw by the targets
    alone, and no component ever moves another; the shares are then off by as much as the largest components happen to be.

    A record without a usable patient or site is a component of its own. More than MOST_SPLITS splits are an error. Repeated record ids of one component get
    one split as do equal rows; the result has one row per input row. An empty table gives an empty result. `targets` is a
    small table (a row for each split); its nulls and shares of 0 or less are left out; no target at all is an error.
    """
    rows = targets.select(split, share).where(f"{split} is not null and {share} > 0").limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    want = {r[0]: float(r[1]) for r in rows}
    if not want:
        raise ValueError("no split with a share above 0")
    total = sum(want.values())
    want = {s: w / total for s, w in want.items()}
    nodes = linked(df, patient, site)
    keyed = df.select(F.col(record).alias("_record"), F.coalesce(F.concat(F.lit("s:"), site_key(site)), F.concat(F.lit("p:"), patient_key(patient))).alias("node"))
    found = keyed.join(nodes, "node", "left").select("_record", F.coalesce("component", F.concat(F.lit("r:"), F.coalesce(F.col("_record").cast("string"), F.lit("null")))).alias("component"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    big = sizes.where(F.col("n") >= max(2, big * n)).orderBy(F.desc("n"), "component").collect() if n and big <= 1 else []  # at most 1 / big rows
    room, placed = dict(want), {}
    for row in big:
        f = row["n"] / n
        fit = {s: r for s, r in room.items() if r >= f} or {max(room, key=lambda s: (room[s], s)): 1.0}
        s = max(fit, key=lambda s: (_local_score(row["component"], s, fit[s], seed), s))
        placed[row["component"]] = s
        room[s] = max(room[s] - f, 1e-9)
    chosen = _choice(F.col("component"), room, seed)
    if placed:
        fixed = F.create_map(*(F.lit(x) for kv in placed.items() for x in kv))
        chosen = F.coalesce(F.try_element_at(fixed, F.col("component")), chosen)
    return found.select(F.col("_record").alias(record), "component", chosen.alias("split_name"))


def _local_score(component: str, split: str, weight: float, seed: int) -> float:
    import hashlib
    import math

    h = int.from_bytes(hashlib.blake2b(f"{component}|{split}|{seed}".encode(), digest_size=8).digest(), "big") >> 12
    return weight / -math.log((h + 0.5) / (1 << 52))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each split: split_name, share, n_records, reached (4 digits)."""
    got = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("n_records"))
    all_ = got.agg(F.sum("n_records")).first()[0] or 0
    return targets.select("split_name", "share").join(got, "split_name", "left").select("split_name", "share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.round(F.coalesce("n_records", F.lit(0)) / F.lit(float(max(all_, 1))), 4).alias("reached"))
