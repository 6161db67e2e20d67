"""Byte-level BPE encoding with numpy matrices (problem 8)."""

import base64
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoframe.session import spread

#: Where the public vocabularies lie, unless a call says otherwise.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the pattern that splits text before byte-level merges (public, as the vocabularies' description gives it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.int32(2**31 - 1)
#: Cells of one matrix; words up to CACHED bytes are remembered, up to CACHE_WORDS of them; beyond LONG bytes a word is merged by a heap instead of rounds over all of it.
CELLS, CACHED, CACHE_WORDS, LONG = 1 << 21, 64, 400_000, 512


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies in JSON write the 256 bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Byte ids and a hash table from pairs of ids to (rank, merged id); a few MB, whatever the corpus.

    leftmost: whether a round may merge the leftmost place of the least pair only. That is so where a merge can give rise to a pair of no higher rank, which
    is found out from the table: each pair must rank above all pairs that make one of its parts. If it can't, all places of the least rank are merged at once, with the same outcome.
    """

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        made = np.full(int(max(left.max(), right.max(), merged.max(), byte_ids.max())) + 1 if len(left) else 1, -1, dtype=np.int64)
        np.maximum.at(made, merged, rank)
        self.leftmost = bool((rank <= np.maximum(made[left], made[right])).any()) if len(left) else False
        self._pairs: dict[tuple[int, int], tuple[int, int]] | None = None
        self.bits = max(10, int(np.ceil(np.log2(max(len(left), 1)))) + 3)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank, self.merged = np.full(1 << self.bits, _NEVER, dtype=np.int32), np.full(1 << self.bits, -1, dtype=np.int32)
        todo = np.arange(len(left))
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        self.probes = 0
        while len(todo):  # each round places the first of all that want a free slot; the others go to the next one
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NEVER if none) and slot of each pair key."""
        slot = self._slot(key)
        for _ in range(self.probes):
            held = self.keys[slot]
            off = np.flatnonzero((held != key) & (held != -1))
            if not len(off):
                break
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
        return np.where(self.keys[slot] == key, self.rank[slot], _NEVER), slot

    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, merged id) by pair: the table once more for single lookups, made when first needed."""
        if self._pairs is None:
            at = np.flatnonzero(self.keys >= 0)
            k = self.keys[at]
            self._pairs = dict(zip(zip((k >> 32).tolist(), (k & 0xFFFFFFFF).tolist(), strict=True), zip(self.rank[at].tolist(), self.merged[at].tolist(), strict=True), strict=True))
        return self._pairs

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """From a .json with vocabulary and merges, or a .tiktoken file of ranks."""
        if path.endswith(".json"):
            model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
            vocab = model["vocab"]
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            byte_ids = np.full(256, -1)
            for letter, b in _byte_letters().items():
                byte_ids[b] = vocab[letter]
            left, right = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
            return cls(byte_ids, left, right, np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges]))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x) for x in zip(*pairs, strict=True))
        return cls(byte_ids, left, right, rank, rank)


def _merge(v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merge a padded matrix (rows of n ids, -1 beyond) to the end; gives (rows, ids, n) as rows get done and leave the matrix."""
    rows = np.arange(len(ids))
    while len(rows):
        width = int(n.max())
        ids = ids[:, :width]
        if width < 2:
            yield rows, ids, n
            return
        a, b = ids[:, :-1], ids[:, 1:]
        rank = np.full(a.shape, _NEVER, dtype=np.int32)
        slot = np.zeros(a.shape, dtype=np.int64)
        real = b >= 0
        rank[real], slot[real] = v.find((a[real].astype(np.int64) << 32) | b[real].astype(np.int64))
        least = rank.min(axis=1)
        done = least == _NEVER
        if done.any():
            yield rows[done], ids[done], n[done]
            go = ~done
            rows, ids, n, rank, slot, least = rows[go], ids[go], n[go], rank[go], slot[go], least[go]
            if not len(rows):
                return
        hit = rank == least[:, None]
        at = np.arange(hit.shape[1])
        if v.leftmost:
            hit = at == hit.argmax(axis=1)[:, None]
        else:  # of overlapping places (x x x) every other one counts, from the left
            gap = np.maximum.accumulate(np.where(hit, -1, at), axis=1)
            hit &= (at - gap) % 2 == 1
        r, c = np.nonzero(hit)
        ids = ids.copy()
        ids[r, c] = v.merged[slot[r, c]]
        keep = ids >= 0
        keep[r, c + 1] = False
        fresh = np.full(ids.shape, -1, dtype=np.int32)
        kr, kc = np.nonzero(keep)
        fresh[kr, (np.cumsum(keep, axis=1) - 1)[kr, kc]] = ids[kr, kc]
        ids, n = fresh, keep.sum(axis=1)


def _merge_long(v: Vocabulary, ids: list[int]) -> tuple[int, ...]:
    """Merge one long word pair by pair, of the least rank the leftmost, over a heap of the pairs' places: n log n, where rounds would take n * rounds."""
    pairs, n = v.pairs(), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(got[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := pairs.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged since
        ids[i], ids[j] = pairs[a, b][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if got := pairs.get((ids[i], ids[k])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[k]))
        h = before[i]
        if h >= 0 and (got := pairs.get((ids[h], ids[i]))):
            heapq.heappush(heap, (got[0], h, ids[h], ids[i]))
    return tuple(x for x in ids if x >= 0)


def encode_words(v: Vocabulary, words: list[bytes]) -> list[tuple[int, ...]]:
    """Ids of each word (bytes of one piece of the pattern); words are bucketed by length into padded matrices."""
    out: list[tuple[int, ...]] = [()] * len(words)
    size = np.array([len(w) for w in words], dtype=np.int64)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for i in np.flatnonzero(size > LONG):
        out[i] = _merge_long(v, v.byte_ids[np.frombuffer(words[i], dtype=np.uint8)].tolist())
    for k in np.unique(bucket):
        members = np.flatnonzero((bucket == k) & (size > 0) & (size <= LONG))
        step = max(1, CELLS >> int(k))
        for s in range(0, len(members), step):
            m = members[s : s + step]
            n = size[m]
            flat = np.frombuffer(b"".join(words[i] for i in m), dtype=np.uint8)
            ids = np.full((len(m), int(n.max())), -1, dtype=np.int32)
            ids[np.arange(ids.shape[1]) < n[:, None]] = v.byte_ids[flat]
            for rows, got, length in _merge(v, ids, n):
                for i, x, z in zip(m[rows].tolist(), got.tolist(), length.tolist(), strict=True):
                    out[i] = tuple(x[:z])
    return out


class Encoder:
    """Encodes texts; remembers short words within bounds."""

    def __init__(self, v: Vocabulary):
        self.v, self.split, self.known = v, regex.compile(PATTERN).findall, {}

    def __call__(self, texts: Iterable[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = list({p for d in pieces for p in d} - known.keys())
        got = dict(zip(new, encode_words(self.v, [p.encode("utf-8") for p in new]), strict=True))
        known.update((p, x) for p, x in got.items() if len(p) <= CACHED)
        long = {p: x for p, x in got.items() if len(p) > CACHED}
        if long:
            return [list(chain.from_iterable(known[p] if p in known else long[p] for p in d)) for d in pieces]
        return [list(chain.from_iterable(map(known.__getitem__, d))) for d in pieces]


def _batches(texts: pd.Series, most_chars: int = 4_000_000) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= most_chars or len(held) >= 2000:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(df: DataFrame, text: str, out: str = "ids", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.json", count_only: bool = False) -> DataFrame:
    """df with a column of token ids (array of int) of the text, or with their number if count_only.

    Null and empty texts give an empty list (0). Strings that look like special tokens are ordinary text; no special tokens are added. Texts are
    encoded whole. Rows, repeated ones too, and all other columns stay; a column already named `out` is an error. An empty table gives an empty result.
    The vocabulary is read once by the driver and sent to the tasks; its size is fixed.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists already")
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    kind = T.IntegerType() if count_only else T.ArrayType(T.IntegerType())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(sent.value)
        for s in parts:
            got = [x for b in _batches(s) for x in encoder(b)]
            yield pd.Series([len(x) for x in got], dtype="int32") if count_only else pd.Series(got, dtype=object)

    return spread(df).withColumn(out, F.pandas_udf(run, kind)(F.col(text)))
