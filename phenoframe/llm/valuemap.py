"""Mapping freely typed values to a canonical list by a prefix-filter set-similarity join (problem 4)."""

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.session import cut, shuffle_partitions, small_enough

#: Buckets of the gram counts that order grams by rarity: all that leaves the cluster. Jaccard threshold of candidates.
BUCKETS, JACCARD = 1 << 16, 0.3
#: The least letters of a word that may be mistyped (shorter ones stand for a name only as they are); of a cut-off word; the least part of the entry that a cut-off word must hold.
WORD, CUT, PART = 4, 5, 0.45
#: Reference rows up to which the list is broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 200_000
#: A letter run; 0 and 1 between letters stand for o, l or i and stay in as mistypings.
_RUN = re.compile(r"(?:[^\W\d_]|[01](?=[^\W\d_]{3}))(?:[^\W\d_]|[01](?=[^\W\d_]))*")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def words_of(value: str) -> list[str]:
    """The letter runs of a value, in order."""
    return _RUN.findall(plain(value))


def grams(word: str) -> list[int]:
    """Hashed bigrams of a word with its ends marked; a repeated bigram counts as further elements."""
    w, seen, out = f"^{word}$", {}, set()
    for i in range(len(w) - 1):
        g = w[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.add(zlib.crc32(f"{g}{seen[g]}".encode()))
    return sorted(out)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between a and b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def allowed(n: int) -> int:
    """Mistypings that a word of n letters may have."""
    return 1 if n < 8 else 2 if n < 12 else 3


def _prefixed(word: pd.Series, freq: np.ndarray) -> list[list[dict]]:
    out = []
    for w in word:
        g = grams(w)
        order = sorted(g, key=lambda x: (freq[x % BUCKETS], x))
        keep = len(g) - math.ceil(JACCARD * len(g) - 1e-9) + 1
        out.append([{"g": x, "p": i} for i, x in enumerate(order[:keep])])
    return out


def _side(words: DataFrame, name: str, freq) -> DataFrame:
    """(word, n, grams) rows, one for each gram of the rare prefix, with its place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            at = _prefixed(d["w"], freq.value)
            n = [len(x) for x in at]
            gs = [grams(w) for w in d["w"]]
            k = np.repeat(np.arange(len(d)), n)
            yield pd.DataFrame({"w": d["w"].to_numpy()[k], "n": np.array([len(x) for x in gs], dtype="int32")[k], "gs": [gs[i] for i in k], "g": [y["g"] for x in at for y in x], "p": np.array([y["p"] for x in at for y in x], dtype="int32")})

    rows = words.mapInPandas(run, "w string, n int, gs array<long>, g long, p int")
    return rows.select("g", *(F.col(c).alias(f"{name}_{c}") for c in ("w", "n", "gs", "p")))


def gram_counts(entries: DataFrame) -> np.ndarray:
    """How many of the list's names (w) have a gram of each bucket. The list's counts order the grams of both sides: what no name has comes first and joins nothing."""

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            yield pd.DataFrame({"k": [x % BUCKETS for w in d["w"] for x in grams(w)]}, dtype="int32")

    count = entries.mapInPandas(hashed, "k int").groupBy("k").count().toPandas()
    freq = np.zeros(BUCKETS, dtype=np.int64)
    freq[count["k"].to_numpy(dtype=int)] = count["count"].to_numpy()
    return freq


def best_entries(words: DataFrame, entries: DataFrame, freq: np.ndarray | None = None, small: bool | None = None) -> DataFrame:
    """For each of distinct words (w) the entry name (w) that it is closest to: word, entry, cost; words near no entry don't come out.

    Words and names become sets of bigrams. Only the rarest grams of each set are joined (a prefix that no pair of Jaccard similarity JACCARD can miss), pairs that fail on
    length or on place are dropped, the rest is verified exactly. A pair holds if the word is the name with no more mistypings than allowed, or its cut-off beginning; of a word's pairs the one
    of the largest similarity stays, of equals that with fewer mistypings, then the first by name. Its cost are the mistypings, a half for a word cut off short.
    A cut-off word that begins several names is dropped as undecidable. Words below WORD letters hold with the name that they are. freq (gram_counts) and small (whether the
    list has at most BROADCAST_ROWS names) are found out unless they are given.
    """
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(gram_counts(entries) if freq is None else freq)
    small = small_enough(entries, BROADCAST_ROWS) if small is None else small
    x, y = _side(words.where(F.length("w") >= WORD), "x", sent), broadcast_if(_side(entries, "y", sent), small)
    sizes = (F.col("x_n") >= JACCARD * F.col("y_n")) & (F.col("y_n") >= JACCARD * F.col("x_n"))
    need = JACCARD / (1 + JACCARD) * (F.col("x_n") + F.col("y_n"))
    place = F.least("x_p", "y_p") + F.least(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p")) >= need - 1e-9
    both = F.size(F.array_intersect("x_gs", "y_gs"))
    pairs = x.join(y, "g").where(sizes & place).withColumn("both", both).withColumn("j", F.col("both") / (F.col("x_n") + F.col("y_n") - F.col("both"))).where(F.col("j") >= JACCARD)
    pairs = pairs.groupBy(F.col("x_w").alias("word"), F.col("y_w").alias("entry")).agg(F.max("j").alias("j"))
    # an exchange of neighbours is one mistyping and two edits, so twice the allowed edits bound what the costlier count may accept
    most = F.when(F.length("entry") < 8, 1).when(F.length("entry") < 12, 2).otherwise(3)
    begins = (F.length("word") >= CUT) & (F.length("word") >= PART * F.length("entry")) & F.col("entry").startswith(F.col("word"))
    pairs = pairs.where(begins | (F.abs(F.length("word") - F.length("entry")) <= most) & (F.levenshtein("word", "entry") <= 2 * most)).repartition(2 * shuffle_partitions(spark), "word", "entry")

    def cost(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            c = []
            for w, e in zip(d["word"], d["entry"], strict=True):
                most = allowed(len(e))
                n = distance(w, e, most)
                cut = len(w) >= CUT and len(w) >= PART * len(e) and e.startswith(w)
                c.append((0.5 if cut and n else float(n)) if n <= most or cut else -1.0)
            yield d.assign(cost=c).loc[lambda z: z["cost"] >= 0]

    good = pairs.mapInPandas(cost, "word string, entry string, j double, cost double")
    best = good.groupBy("word").agg(F.min(F.struct(-F.round("j", 9), "cost", "entry")).alias("b"), F.sum((F.col("cost") == 0.5).cast("int")).alias("cut"))
    best = best.where("not (b.cost = 0.5 and cut > 1)").select("word", "b.entry", "b.cost")
    short = words.where(F.length("w") < WORD).join(broadcast_if(entries.where(F.length("w") < WORD), small), "w", "left_semi")
    return best.unionByName(short.select(F.col("w").alias("word"), F.col("w").alias("entry"), F.lit(0.0).alias("cost")))


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def map_values(df: DataFrame, value: str, ref: DataFrame, ref_id: str, canonical: str, brand: str) -> DataFrame:
    """Each distinct value that is not null or blank with the ref_id of the entry that it means, 0 if it means none: value, ref_id.

    A name may be mistyped, cut off, split, written with accents or in any case, and have other words around it. Values are taken apart into
    words, distinct words are matched to the names of the list (best_entries), and the words found decide: two substances together mean the entry
    that joins them (its canonical name has them with a /, in either order), else the entry of the best word; a brand is its entry's substance. Without
    a joined entry the better match counts, of equally good ones the first word's. The list may be empty (all 0); entries without an id or name are left out; of two
    entries with one name the least id counts. Only distinct values and words are shuffled, so frequent values cost nothing extra.
    """
    r = ref.where(F.col(ref_id).isNotNull()).select(F.col(ref_id).cast("long").alias("ref_id"), F.col(canonical).alias("c"), F.col(brand).alias("b"))

    def shapes(parts_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts_:
            yield x.map(lambda v: "".join(words_of(v or "")))

    shape = F.pandas_udf(shapes, "string")
    part = F.explode(F.split("c", r"\s*/\s*"))
    parts = r.where("c is not null").select("ref_id", F.size(F.split("c", "/")).alias("k"), part.alias("name")).select("ref_id", "k", shape("name").alias("name"))
    single = parts.where("k = 1").groupBy("name").agg(F.min("ref_id").alias("ref_id"))
    brands = r.where("b is not null").select(shape("b").alias("name"), "ref_id").groupBy("name").agg(F.min("ref_id").alias("ref_id"))
    loose = parts.where("k > 1").select("name").distinct().join(single, "name", "left_anti").select("name", F.lit(0).cast("long").alias("ref_id"))
    # name -> the substance that it stands for, and the entry of it alone (0: the list has it in joined entries only)
    ours = single.select("ref_id", F.col("name").alias("substance"))
    named = single.select("name", F.col("name").alias("substance"), "ref_id").unionByName(loose.select("name", F.col("name").alias("substance"), "ref_id"))
    named = named.unionByName(brands.join(single, "name", "left_anti").join(ours, "ref_id", "left").select("name", F.coalesce("substance", F.concat(F.lit("#"), F.col("ref_id").cast("string"))).alias("substance"), "ref_id"))
    named = cut(named.where("name <> ''"))  # read several times
    joined = parts.where("k > 1").groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "/").alias("key")).groupBy("key").agg(F.min("ref_id").alias("joined_id"))

    values = df.where(F.length(F.regexp_replace(value, r"(?U)\s+", "")) > 0).select(F.col(value).alias("value")).distinct().withColumn("vid", F.unhex(F.md5("value")))

    def taken_apart(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts_:
            got = [(k, i, w) for k, v in zip(d["vid"], d["value"], strict=True) for i, w in enumerate(words_of(v))]
            yield pd.DataFrame(got, columns=["vid", "lo", "w"])

    n = 2 * shuffle_partitions(df.sparkSession)  # another number than that of the shuffle before, else the two become one and its few bytes one task
    words = cut(values.mapInPandas(taken_apart, "vid binary, lo int, w string"))
    names = named.select(F.col("name").alias("w")).distinct()
    meaning = named.select(F.col("name").alias("entry"), "substance", "ref_id")
    freq, small = gram_counts(names), small_enough(named, BROADCAST_ROWS)
    alone = cut(best_entries(words.select("w").distinct().repartition(n, "w"), names, freq, small))
    # A blank or dash may have got into a word: neighbours that mean nothing alone are tried as one.
    rest = words.join(alone.select(F.col("word").alias("w")), "w", "left_anti")
    pairs = rest.select("vid", "lo", "w").join(rest.select("vid", (F.col("lo") - 1).alias("lo"), F.col("w").alias("next")), ["vid", "lo"])
    pairs = cut(pairs.where(F.length("w") + F.length("next") >= WORD + 2).select("vid", "lo", F.concat("w", "next").alias("w")))
    joined_up = best_entries(pairs.select("w").distinct().repartition(n, "w"), names, freq, small)
    spots = words.select("vid", "lo", F.col("lo").alias("hi"), "w").join(alone.withColumnRenamed("word", "w"), "w")
    spots = spots.unionByName(pairs.select("vid", "lo", (F.col("lo") + 1).alias("hi"), "w").join(joined_up.withColumnRenamed("word", "w"), "w"))
    at = spots.join(meaning, "entry").groupBy("vid", "substance", "ref_id").agg(F.min(F.struct("cost", "lo", "hi")).alias("m"))
    # a word pair and the words in it must not both speak: per value the cheapest reading of every word wins
    per = at.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct(F.col("m.cost").alias("cost"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), "substance", "ref_id"))).alias("ms"))
    kept = F.aggregate("ms", F.slice("ms", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y["lo"] <= x["hi"]) & (x["lo"] <= y["hi"])), acc).otherwise(F.concat(acc, F.array(x))))
    per = per.select("vid", kept.alias("ms")).select("vid", F.array_join(F.array_sort(F.array_distinct(F.transform(F.slice("ms", 1, 2), lambda x: x["substance"]))), "/").alias("key"), F.element_at("ms", 1)["ref_id"].alias("first_id"))
    joined = broadcast_if(joined, small)  # no more rows than names
    chosen = per.join(joined, "key", "left").select("vid", F.coalesce("joined_id", "first_id").alias("ref_id"))
    return values.join(chosen, "vid", "left").select("value", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id"))


def map_rows(df: DataFrame, ident: str, value: str, ref: DataFrame, ref_id: str, canonical: str, brand: str) -> DataFrame:
    """One row per distinct id with a value that is not null or blank: ident, ref_id. Of an id with several values the least ref_id above 0 counts."""
    got = map_values(df, value, ref, ref_id, canonical, brand)
    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), F.col(value).alias("value")).join(got, "value")
    return rows.groupBy("_id").agg(F.coalesce(F.min(F.when(F.col("ref_id") > 0, F.col("ref_id"))), F.lit(0)).alias("ref_id")).select(F.col("_id").alias(ident), "ref_id")


def unmatched(df: DataFrame, value: str, ref: DataFrame, ref_id: str, canonical: str, brand: str) -> DataFrame:
    """Values that mean no entry, with the number of rows that hold them: value, n_rows."""
    got = map_values(df, value, ref, ref_id, canonical, brand).where("ref_id = 0")
    n = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return got.join(n, "value").select("value", "n_rows")
