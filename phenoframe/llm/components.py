"""Connected components by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.session import cut


def _mark(c: DataFrame) -> tuple:
    """Size and order-free checksums of the clusters, to see whether a round changed anything."""
    h = F.xxhash64("v", "u")
    return tuple(c.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def hash_to_min(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph as rows (node, component); component is its least node.

    Each node keeps a cluster, at first itself and its neighbours. In a round it sends the whole cluster
    to the cluster's least node and that least node to all others; when nothing changes, the least node of
    each component holds all of it. Clusters are kept as rows (v, u), never as arrays, so no group has to fit
    into one task: the minimum is pre-aggregated, and the join that follows may be split by AQE for a hot v.
    Rows with a null end link nothing; a loop (a, a) makes a single node; an empty input gives no rows.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    c = cut(
        e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        .unionByName(e.select("v", F.col("v").alias("u")))
        .unionByName(e.select(F.col("u").alias("v"), "u"))
        .distinct()
    )
    mark = _mark(c)
    for _ in range(most_rounds):
        least = c.groupBy("v").agg(F.min("u").alias("m"))
        met = c.join(least, "v")
        c = cut(
            met.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
            .select("x.v", "x.u")
            .distinct()
        )
        mark, before = _mark(c), mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return c.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")


def pairs_within(df: DataFrame, group: str, value: str, rows: int = 4096) -> DataFrame:
    """Each pair a < b of distinct values of a group: a, b. For groups whose pairs are asked for.

    A group of more than `rows` values is cut into parts by hash, and each of its parts meets each other one in a group of its own, so that no task holds a large group;
    smaller groups have one part. Null groups and values pair with nothing.
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")).distinct()
    parts = d.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / rows).cast("int").alias("k"))
    d = d.join(parts, "g").withColumn("p", F.pmod(F.xxhash64("v", F.lit(11)), F.col("k")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    a = d.select("g", "p", each.alias("q"), F.col("v").alias("a"))
    b = d.select("g", F.col("p").alias("q"), each.alias("p"), F.col("v").alias("b"))
    return a.join(b, ["g", "p", "q"]).where("a < b").select("a", "b")
