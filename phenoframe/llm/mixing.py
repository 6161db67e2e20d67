"""Mixing sources to target weights by Pareto order sampling (problem 9)."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenoframe.session import cut

#: Bins of the ranking by which the cut is found; rows of one bin that a task may sort.
BINS, SORTED = 4096, 200_000


def budgets(docs: DataFrame, targets: DataFrame, source: str, size: str, total: int | None = None) -> DataFrame:
    """One row for each target source: source, target_share, max_repeats, n_docs, available, budget (tokens it is to give).

    Sources without documents can give nothing: their share falls to the others in proportion. Unless a total is given, it is the largest at which
    every source that has documents reaches its share within its repeats. Sources without a target give nothing. docs must hold (source, size).
    """
    have = docs.where(F.col(source).isNotNull() & (F.col(size) > 0)).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(size).cast("long")).alias("available"))
    t = targets.where("source is not null and target_share > 0").select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    t = t.join(have, "source", "left").na.fill(0, ["n_docs", "available"])
    can = t.where("available > 0 and max_repeats > 0")
    one = can.agg(F.sum("target_share").alias("w"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("least")).first()
    weight, least = one["w"] or 1.0, one["least"] or 0.0
    whole = float(total) if total is not None else least * weight  # least over sources of available * repeats / (share / weight)
    share = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share") / weight).otherwise(0.0)
    want = F.least(F.lit(whole) * share, (F.col("available") * F.col("max_repeats")).cast("double"))
    return t.withColumn("budget", F.floor(want + F.lit(1e-6)).cast("long"))


def _factor(sizes: pd.DataFrame) -> pd.DataFrame:
    """The factor c of one source for which the expected tokens, the sum of size * min(1, c * w) over its documents, are `rest`."""
    s = sizes.sort_values(["w", "size"], ascending=False)
    tokens, w = (s["size"] * s["n"]).to_numpy(dtype=float), s["w"].to_numpy(dtype=float)
    rest = float(s["rest"].iloc[0])
    sure = np.r_[0.0, np.cumsum(tokens)]  # tokens of the first k sizes, all taken
    weighted = np.r_[np.cumsum((tokens * w)[::-1])[::-1], 0.0]  # tokens * w of the others
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (rest - sure) / weighted
    k = next((k for k in range(len(w)) if c[k] * w[k] <= 1 + 1e-12), len(w))
    return pd.DataFrame({"source": [s["source"].iloc[0]], "factor": [max(c[k], 0.0) if k < len(w) else 1.0 / w.min()]})


def mix(docs: DataFrame, targets: DataFrame, ident: str, source: str, size: str, total: int | None = None, power: float = 0.5, seed: int = 29) -> DataFrame:
    """The mix: ident, source, size and copies (1 or more) of each chosen document.

    A source's budget is met in two steps. Its documents first get the whole copies that all of them are certain to get (budget div available). For the rest, a fraction p of the source, every
    document has an inclusion probability in proportion to size ** power, at most 1, whose expected tokens are those of the rest (what documents at 1 would be above it falls to the others), and a rank of (u / (1 - u)) / (pi / (1 - pi)), u its own keyed random
    number: Pareto order sampling. Documents are taken in the order of rank while they fit into the budget, so the tokens of a source fall short of its budget by less than the
    document that no longer fits. Where the cut lies is found from counts of tokens in bins of the rank, then within one bin, refined until a
    bin is small; no source is ever sorted as a whole. power 0 gives all documents of a source the same chance.

    No document gets more than its source's max_repeats copies. Rows with a null id or source or a size that is null or 0 are not taken; of an id that comes twice each row counts as a document of its own.
    Sources without a target give nothing. The same seed gives the same mix, at any partitioning. Empty tables give an empty result.
    """
    d = docs.where(F.col(ident).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(ident).alias("_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    b = budgets(d, targets, "source", "size", total).where("budget > 0").withColumns({"whole": F.expr("budget div available"), "rest": F.expr("budget % available")})
    d = d.join(F.broadcast(b.select("source", "whole", "rest", "available", "max_repeats", "n_docs")), "source")  # one row a target
    d = d.withColumn("w", F.pow("size", F.lit(power)))
    # sizes of each source with their numbers of documents: as many rows as there are sizes; from these the factor of the odds
    sizes = d.groupBy("source", "size").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    d = d.join(F.broadcast(sizes.groupBy("source").applyInPandas(_factor, "source string, factor double")), "source")  # one row a target
    pi = F.least(F.greatest(F.col("factor") * F.col("w"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = (F.pmod(F.xxhash64("_id", "source", F.lit(seed)), F.lit(1 << 50)).cast("double") + 0.5) / float(1 << 50)
    d = d.withColumn("rank", (u / (1 - u)) / (pi / (1 - pi)))
    # the rank folded into (0, 1), so that bins can be laid over it; kept, as each refinement of the cut reads it
    d = cut(d.select("_id", "source", "size", "whole", "max_repeats", (F.col("rank") / (1 + F.col("rank"))).alias("pos")))
    low = b.select("source", "rest").withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0), "left": F.col("rest")})
    for _ in range(8):
        held = d.join(F.broadcast(low.select("source", "lo", "hi")), "source").where("pos >= lo and pos < hi")
        bins = held.groupBy("source", F.least(F.floor((F.col("pos") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        cum = bins.withColumn("upto", F.sum("t").over(w)).join(F.broadcast(low), "source")
        edge_bin = cum.where("upto > left").groupBy("source").agg(F.min("bin").alias("bin"), F.min_by("n", "bin").alias("n"), F.min_by(F.col("upto") - F.col("t"), "bin").alias("before"))
        step = low.join(edge_bin, "source", "left")
        width = (F.col("hi") - F.col("lo")) / BINS
        next_ = step.select("source", "rest", F.coalesce(F.col("lo") + F.col("bin") * width, "hi").alias("lo"), F.coalesce(F.col("lo") + (F.col("bin") + 1) * width, "hi").alias("hi"), (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))
        rows = next_.collect()  # one row a target source
        low = docs.sparkSession.createDataFrame([tuple(r)[:5] for r in rows], "source string, rest long, lo double, hi double, left long") if rows else low
        if all(r["n"] <= SORTED for r in rows):
            break
    at = d.join(F.broadcast(low.select("source", "lo", "hi", "left")), "source")
    edge = at.where("pos >= lo and pos < hi").withColumn("run", F.sum("size").over(Window.partitionBy("source").orderBy("pos", "_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = edge.where("run <= left").select("source", "_id", "pos").distinct().withColumn("_in", F.lit(1))
    got = at.join(taken, ["source", "_id", "pos"], "left").withColumn("copies", (F.col("whole") + F.when((F.col("pos") < F.col("lo")) | F.col("_in").isNotNull(), 1).otherwise(0)).cast("int"))
    return got.where("copies > 0").select(F.col("_id").alias(ident), "source", "size", F.least("copies", "max_repeats").alias("copies"))


def mix_report(chosen: DataFrame, docs: DataFrame, targets: DataFrame, source: str, size: str, total: int | None = None) -> DataFrame:
    """What each target source gives: source, target_share, max_repeats, n_docs and tokens available, budget, documents and tokens chosen, most copies, share reached."""
    b = budgets(docs, targets, source, size, total)
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_chosen"), F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    r = b.join(got, "source", "left").na.fill(0, ["n_chosen", "tokens", "most_copies"])
    all_ = r.agg(F.sum("tokens")).first()[0] or 0
    return r.withColumn("share_reached", F.round(F.col("tokens") / F.lit(float(max(all_, 1))), 4))
