"""Near-duplicate records by set similarity, in rare-token blocks walked by runs of sizes and bitmaps (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.components import hash_to_min, pairs_within
from phenoframe.session import cut, shuffle_partitions

#: Buckets of the token counts that order tokens by rarity: a table of this fixed size is all that leaves the cluster.
BUCKETS = 1 << 20
#: 64-bit words of a bitmap; documents of a leaf; children of a node.
WORDS, LEAF, FAN = 4, 4, 4
#: Rows of a token's block that one task compares; a larger block is split into tiles, compared pair by pair of tiles.
TILE = 8192


def words(text: Column) -> Column:
    """Lower case, without all characters but letters, digits and white space, split at white space."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{Nd}\s]+", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: F.length(w) > 0)


def shingles(df: DataFrame, ident: str, text: str, run: int, least_words: int) -> DataFrame:
    """_doc, _n and _tokens: the sorted distinct hashes of all runs of `run` words, for texts of at least least_words words."""
    w = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("_doc"), words(F.col(text)).alias("w"))
    w = w.where(F.size("w") >= max(least_words, run))
    t = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - run), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(run))))))
    return w.select("_doc", t.alias("_tokens")).withColumn("_n", F.size("_tokens"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def _place(tokens: np.ndarray) -> np.ndarray:
    mixed = (tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed % np.uint64(WORDS * 64)).astype(np.int64)


def _bits(owner: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, WORDS * 64), dtype=bool)
    m[owner, _place(tokens)] = True
    return np.packbits(m, axis=1).view(np.uint64)


def _odd(tokens: np.ndarray) -> np.ndarray:
    """Row k: which bits an odd number of the tokens before k has; of any run of tokens, the first row ^ the row after its last."""
    at = _place(tokens)
    m = np.zeros((len(tokens) + 1, WORDS), dtype=np.uint64)
    m[np.arange(1, len(m)), at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
    return np.bitwise_xor.accumulate(m, axis=0)


#: What a row of a prefix holds besides its block (token, part): the document, its tokens (32 bits), the block's side (1 bit) and the token's place (31 bits), and the bitmap of the tokens from that place on.
_PREFIX = "token long, part long, doc long, size_pos long, " + ", ".join(f"b{i} long" for i in range(WORDS))


def _tiles(docs: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of blocks in several tiles: which row, part and side. A row meets each tile of its block in a part of its own; sides tell the tiles of a part."""
    which = np.repeat(np.arange(len(docs)), tiles)
    g = tiles[which]
    own = ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64)[which] % g
    other = np.arange(len(which)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    lo, hi = np.minimum(own, other), np.maximum(own, other)
    return which, 1 + lo * g + hi, ((own == hi) & (lo != hi)).astype(np.int64)


def _prefix(counts, t: float):
    """Rows of each document's rare prefix. Documents are ordered by (bucket count, token), the same order everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                lists = batch.column("_tokens")
                docs = batch.column("_doc").to_numpy()
                off = lists.offsets.to_numpy()
                tokens = lists.values.to_numpy()[off[0] : off[-1]]
                n = np.diff(off)
                owner = np.repeat(np.arange(len(docs)), n)
                count = freq[tokens % BUCKETS]
                order = np.lexsort((tokens, count, owner))
                owner, tokens, count = owner[order], tokens[order], count[order]
                pos = np.arange(len(owner)) - (off[:-1] - off[0])[owner]
                odd = _odd(tokens)
                probe = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
                k = np.flatnonzero((pos < probe[owner]) & (count > 1))  # what occurs once links nothing
                tiles = -(-count[k].astype(np.int64) // TILE)
                narrow, wide = k[tiles == 1], k[tiles > 1]
                which, part, side = _tiles(docs[owner[wide]], tiles[tiles > 1])
                k = np.r_[narrow, wide[which]]
                part, side = np.r_[np.zeros(len(narrow), dtype=np.int64), part], np.r_[np.zeros(len(narrow), dtype=np.int64), side]
                o = owner[k]
                cols = [tokens[k], part, docs[o], n[o].astype(np.int64) << 32 | side << 31 | pos[k]]
                bits = odd[(off[1:] - off[0])[o]] ^ odd[k]
                cols += [bits[:, i].copy().view(np.int64) for i in range(WORDS)]
                for a in range(0, len(k), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000]) for c in cols], names=[c.split()[0] for c in _PREFIX.split(", ")])

    return run


class _Level:
    """Nodes of one level: where their children begin and end in the level below, and what bounds their documents."""

    __slots__ = ("begin", "end", "bits", "least", "most", "slack")

    def __init__(self, begin, end, bits, least, most, slack):
        self.begin, self.end, self.bits, self.least, self.most, self.slack = begin, end, bits, least, most, slack

    @classmethod
    def over(cls, group: np.ndarray, width: int, bits, least, most, slack) -> tuple[_Level, np.ndarray]:
        """Nodes over runs of at most `width` neighbours of one group; also each node's group."""
        n = len(group)
        first = np.r_[True, group[1:] != group[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        begin = np.flatnonzero((np.arange(n) - start) % width == 0)
        end = np.r_[begin[1:], n]
        return cls(begin, end, np.bitwise_or.reduceat(bits, begin, axis=0), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin), np.maximum.reduceat(slack, begin)), group[begin]


def _expand(a, b, level: _Level):
    """All pairs of children of the node pairs (a, b); of a node with itself each pair once."""
    na, nb = level.end[a] - level.begin[a], level.end[b] - level.begin[b]
    size = na * nb
    which = np.repeat(np.arange(len(a)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    x, y = level.begin[a][which] + k // nb[which], level.begin[b][which] + k % nb[which]
    ok = (a[which] != b[which]) | (x <= y)
    return x[ok], y[ok]


def dual_traversal(block, side, n, pos, indexed, slack, bits, t: float, seen: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that may be similar, from the blocks' signature trees; arrays of row numbers i, j, piece by piece. The queries use windowed, which meets fewer pairs.

    Rows must be sorted by block, side and n. A pair of nodes is dropped when no pair of documents under them can reach the overlap
    that their least sizes demand: a token in common sets a common bit, and only as many tokens as the slack share bits. All blocks are walked together, level by level.
    seen, if given, gets counts: pairs of rows in the blocks (`block`), those that the trees leave (`trees`), that the prefix rules leave (`prefix`) and that the rows' bitmaps leave (`bitmap`).
    """
    count = lambda what, n: None if seen is None else seen.__setitem__(what, seen.get(what, 0) + int(n))
    if seen is not None:
        m = np.bincount(block * 2 + side, minlength=2 * (int(block.max()) + 1 if len(block) else 0)).reshape(-1, 2)
        count("block", np.where(m.min(axis=1) > 0, m[:, 0] * m[:, 1], m[:, 0] * (m[:, 0] - 1) // 2).sum())
    need = t / (1 + t)
    group = block * 2 + side
    levels, g = [], group
    level, g = _Level.over(g, LEAF, bits, n, n, slack)
    levels.append(level)
    while len(g) > 1 and (g[1:] == g[:-1]).any():
        level, g = _Level.over(g, FAN, levels[-1].bits, levels[-1].least, levels[-1].most, levels[-1].slack)
        levels.append(level)
    roots = np.arange(len(g))
    cross = np.flatnonzero((g[1:] == g[:-1] + 1) & (g[:-1] % 2 == 0)) if len(g) > 1 else np.zeros(0, dtype=np.int64)
    crossed = np.zeros(len(g), dtype=bool)
    crossed[cross] = crossed[cross + 1] = True
    alone = roots[~crossed & (g % 2 == 0)]
    todo = [(len(levels) - 1, np.r_[alone, cross], np.r_[alone, cross + 1])]
    while todo:
        at, a, b = todo.pop()
        if len(a) > 50_000:
            todo += [(at, a[s : s + 50_000], b[s : s + 50_000]) for s in range(0, len(a), 50_000)]
            continue
        v = levels[at]
        sizes = (v.most[a] >= t * v.least[b] - 1e-9) & (v.most[b] >= t * v.least[a] - 1e-9)
        a, b = a[sizes], b[sizes]
        reach = np.minimum(v.slack[a], v.slack[b]) + _popcount(v.bits[a] & v.bits[b])
        keep = (a == b) | (reach >= need * (v.least[a] + v.least[b]) - 1e-9)
        a, b = _expand(a[keep], b[keep], v)
        if not len(a):
            continue
        if at:
            todo.append((at - 1, a, b))
            continue
        i, j = a[a != b], b[a != b]
        count("trees", len(i))
        swap = n[i] > n[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        low = need * (n[i] + n[j]) - 1e-9
        tie = n[i] == n[j]
        ok = (indexed[i] | (tie & indexed[j])) & (n[i] >= t * n[j] - 1e-9) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= low)
        i, j, low = i[ok], j[ok], low[ok]
        count("prefix", len(i))
        ok = (n[i] + n[j] - _popcount(bits[i] ^ bits[j])) / 2 >= low
        count("bitmap", ok.sum())
        if ok.any():
            yield i[ok], j[ok]


def windowed(block, side, n, pos, bits, t: float, seen: dict[str, int] | None = None, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that may be similar and have nothing in common before the block's token; arrays of row numbers i, j, the smaller document first, piece by piece.

    Every similar pair comes out in the block of the first token that it has in common, if bits are those of the tokens from the block's on (`_odd`). There these tokens hold the whole overlap that both sizes
    demand, which bounds the other's size: n_j <= (n_i - pos_i) (1 + t) / t - n_i. So a row need only meet the rows of its block from its own size up to that bound, a run of neighbours found by bisection,
    short where the token stands late in its prefix, that is where blocks are large. What the other row's bound excludes goes next, then pairs whose tokens from there on differ in more than the
    demanded overlap leaves: each of these changes one bit. Rows must be sorted by block, side and n. Pieces are of at most `most` pairs of a run, or one row's.
    seen, if given, gets counts: pairs in the runs (`window`), those that both bounds leave (`prefix`) and that the bitmaps leave (`bitmap`).
    """
    count = lambda what, k: None if seen is None else seen.__setitem__(what, seen.get(what, 0) + int(k))
    need = t / (1 + t)
    rest = n - pos - 2 * need * n  # of two rows: by how many tokens they may differ from the block's on
    far = np.floor((n - pos) / need - n + 1e-6).astype(np.int64)
    group = block * 2 + side
    key = group << 32 | n
    first, last = np.searchsorted(group, block * 2), np.searchsorted(group, block * 2 + 1, side="right") - 1
    crossed = side[first] != side[last]  # rows of two tiles meet across, rows of one tile each other
    other = (group ^ crossed) << 32
    begin = np.where(crossed, np.searchsorted(key, other | (n + side)), np.arange(len(n)) + 1)  # of equal sizes the first side's row comes first
    size = np.where(crossed | (side == 0), np.maximum(np.searchsorted(key, other | np.maximum(far, 0), side="right") - begin, 0), 0)
    rows = np.flatnonzero(size)
    total = np.cumsum(size[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        r, k = rows[at:to], size[rows[at:to]]
        at = to
        i = np.repeat(r, k)
        j = np.arange(len(i)) + np.repeat(begin[r] - np.cumsum(k) + k, k)
        count("window", len(i))
        ok = n[i] <= far[j]
        i, j = i[ok], j[ok]
        count("prefix", len(i))
        ok = _popcount(bits[i] ^ bits[j]) <= rest[i] + rest[j] + 1e-6
        i, j = i[ok], j[ok]
        count("bitmap", len(i))
        if len(i):
            yield i, j


def _blocks(t: float, rows: int = 60_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {k: table.column(k).to_numpy() for k in table.column_names}
            new = np.r_[True, (c["token"][1:] != c["token"][:-1]) | (c["part"][1:] != c["part"][:-1])]
            block = np.cumsum(new) - 1
            many = np.flatnonzero(np.bincount(block)[block] > 1)
            if not len(many):
                return
            size_pos = c["size_pos"][many]
            n, side, pos = size_pos >> 32, size_pos >> 31 & 1, size_pos & 0x7FFFFFFF
            order = np.argsort((block[many] * 2 + side) << 32 | n)
            rows = many[order]
            doc = c["doc"][rows]
            bits = np.stack([c[f"b{i}"][rows].view(np.uint64) for i in range(WORDS)], axis=1)
            some, size = [], 0  # pairs are passed on as they come: a group of many copies is never held as a whole
            for i, j in windowed(block[rows], side[order], n[order], pos[order], bits, t):
                a, b = doc[i], doc[j]
                some.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                size += len(a)
                if size >= 200_000:
                    yield from written(some)
                    some, size = [], 0
            yield from written(some)

        def written(some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            both = np.unique(np.concatenate(some), axis=0) if some else np.zeros((0, 2), dtype=np.int64)
            for s in range(0, len(both), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(both[s : s + 50_000, 0]), pa.array(both[s : s + 50_000, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        held_n = 0
        for batch in batches:
            held.append(batch)
            held_n += batch.num_rows
            if held_n < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
            last = np.flatnonzero((token != token[-1]) | (part != part[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield from pairs(table.slice(0, cut_at))
            held = table.slice(cut_at).to_batches()
            held_n = table.num_rows - cut_at
        if held_n:
            yield from pairs(pa.Table.from_batches(held))

    return run


def similar(base: DataFrame, t: float) -> DataFrame:
    """Exact pairs a < b of distinct token sets with a Jaccard similarity of at least t, over rows (_doc, _tokens, _n).

    Each set enters the blocks of its rarest tokens (a prefix long enough that no pair is lost); within a block sizes, places and bitmaps leave few pairs (`windowed`).
    What is left is verified on the whole sets. base is read several times and should be cut from its lineage.
    """
    spark = base.sparkSession
    count = base.select(F.explode("_tokens").alias("x")).select(F.pmod("x", F.lit(BUCKETS)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).toArrow()
    freq = np.zeros(BUCKETS, dtype=np.int32)
    freq[count.column("k").to_numpy()] = np.minimum(count.column("c").to_numpy(), 2**31 - 1)
    sent = spark.sparkContext.broadcast(freq)
    rows = base.select("_doc", "_tokens").mapInArrow(_prefix(sent, t), _PREFIX)
    n = 4 * shuffle_partitions(spark)
    near = rows.repartition(n, "token", "part").sortWithinPartitions("token", "part").mapInArrow(_blocks(t), "a long, b long").distinct()
    x, y = base.select(F.col("_doc").alias("a"), F.col("_tokens").alias("x")), base.select(F.col("_doc").alias("b"), F.col("_tokens").alias("y"))
    both = near.join(x.hint("merge"), "a").join(y.hint("merge"), "b")  # the size of arrays is not known to the planner: no broadcast
    inter = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", inter).where(F.col("i") / (F.size("x") + F.size("y") - F.col("i")) >= t).select("a", "b")


def _prepared(df: DataFrame, ident: str, text: str, run: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """The distinct token sets, each by its least id; and (_doc, rep): the set that each record has.

    Texts are put in one row an id first, which also spreads them; the sets are written to the checkpoint folder partitioned by id, where the joins of the verification find them.
    """
    rows = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(ident).cast("long").alias("_id")).agg(F.min(text).alias("_text"))
    base = cut(shingles(rows, "_id", "_text", run, least_words).withColumn("_h", F.struct(F.xxhash64("_tokens"), F.xxhash64(F.reverse("_tokens"), F.lit(7)))))
    groups = base.groupBy("_n", "_h").agg(F.min("_doc").alias("rep"))
    member = cut(base.select("_doc", "_n", "_h").join(groups, ["_n", "_h"]).select("_doc", "rep"))
    copies = member.where("_doc <> rep").select("_doc")
    return base.join(copies.hint("merge"), "_doc", "left_anti").select("_doc", "_tokens", "_n"), member


def near_pairs(df: DataFrame, ident: str, text: str, run: int = 5, t: float = 0.8, least_words: int = 1) -> DataFrame:
    """All pairs of records, smaller id first, whose sets of runs of `run` words have at least the share t of their union in common: a, b.

    Exact. Records with equal sets are compared once, by one of them, and expanded at the end. A null or empty text, one with fewer
    than least_words words, and a null id pair with nothing. Of rows that repeat an id one counts. Ids are integers. An empty table gives an empty result.
    """
    reps, member = _prepared(df, ident, text, run, least_words)
    found = similar(reps, t)
    x, y = member.select(F.col("rep").alias("a"), F.col("_doc").alias("x")), member.select(F.col("rep").alias("b"), F.col("_doc").alias("y"))
    across = found.join(x, "a").join(y, "b").select("x", "y")
    within = pairs_within(member, "rep", "_doc").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(df: DataFrame, ident: str, text: str, run: int = 5, t: float = 0.8, least_words: int = 1) -> DataFrame:
    """One row per compared record: its class (the least id of its connected component) and its links to other records: id, class_id, n_links.

    Copies are not expanded into pairs: their links to each other and to the records of similar texts are counted from the sizes of groups of copies. Records that
    are not compared do not come out.
    """
    reps, member = _prepared(df, ident, text, run, least_words)
    found = cut(similar(reps, t))
    size = cut(member.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other")))).alias("x")).select("x.*")
    ends = both.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("across"))
    at = hash_to_min(found, "a", "b").withColumnRenamed("node", "rep")
    out = member.join(size, "rep").join(ends, "rep", "left").join(at, "rep", "left")
    return out.select(F.col("_doc").alias(ident), F.coalesce("component", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
