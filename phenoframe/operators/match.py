"""Keyword matching over the words of sentences, with negation, history and windowed scopes.

Sentences come as array<array<string>> (functions.text.sentence_tokens, stemmed or not); everything but the windowed scope is
built from the JVM's higher-order functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phenoframe.functions.text import col

# Triggers of the windowed scope.
BEFORE = ("no", "deny", "absence", "not", "negative", "without", "rule out", "unlikely", "free of", "never", "unremarkable for")
AFTER = ("ruled out", "excluded", "negative", "absent")
PSEUDO = ("not only", "no increase")
WINDOW = 5


def strings(*words: str) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def has_all(sentence: Column, keyword: str) -> Column:
    """Whether the sentence holds all words of the keyword, in any order."""
    return F.size(F.array_except(strings(*keyword.split()), sentence)) == 0


def has_any(sentence: Column, words: list[str]) -> Column:
    return F.arrays_overlap(sentence, strings(*words))


def _flag(sentences: Column | str, test) -> Column:
    return F.coalesce(F.exists(col(sentences), test).cast("int"), F.lit(0))


def bag(sentences: Column | str, keyword: str) -> Column:
    """1 if any sentence holds all words of the keyword."""
    return _flag(sentences, lambda s: has_all(s, keyword))


def bag_negated(sentences: Column | str, keyword: str, negators: list[str]) -> tuple[Column, Column]:
    """(asserted, negated): 1 if a sentence with the keyword has no negator, or has one; both may be 1. Negators are single words."""
    return (
        _flag(sentences, lambda s: has_all(s, keyword) & ~has_any(s, negators)),
        _flag(sentences, lambda s: has_all(s, keyword) & has_any(s, negators)),
    )


def bag_with(sentences: Column | str, keyword: str, words: list[str]) -> Column:
    """1 if a sentence with the keyword also has one of the words (history, say)."""
    return _flag(sentences, lambda s: has_all(s, keyword) & has_any(s, words))


def pair_negated(sentences: Column | str, ones: list[str], other: str, negators: list[str]) -> tuple[Column, Column]:
    """(asserted, negated) for sentences that have one of `ones` and the word `other`."""
    hit = lambda s: has_any(s, ones) & F.array_contains(s, other)
    return _flag(sentences, lambda s: hit(s) & ~has_any(s, negators)), _flag(sentences, lambda s: hit(s) & has_any(s, negators))


def word_flags(sentences: Column | str, words: list[str]) -> dict[str, Column]:
    """1 for each word that any sentence has."""
    every = F.flatten(col(sentences))
    return {w: F.coalesce(F.array_contains(every, w).cast("int"), F.lit(0)) for w in words}


def trigger_table(before: Iterable[str], after: Iterable[str], pseudo: Iterable[str]) -> dict[tuple[str, ...], str]:
    """Kind of each trigger by its words. A phrase of several kinds is one before rather than after, and one of these rather than a pseudo trigger."""
    kinds = (("pseudo", pseudo), ("after", after), ("before", before))
    return {tuple(phrase.split()): kind for kind, phrases in kinds for phrase in phrases}


def scopes(tokens: list[str], triggers: dict[tuple[str, ...], str], window: int = WINDOW) -> list[tuple[int, int]]:
    """Inclusive stretches of a sentence that its triggers negate.

    Each trigger found is a stretch of words. One of kind before negates from its last word `window` words onward, one of kind after from its first word
    `window` words back. A pseudo trigger lifts whatever stretches the triggers read until then have negated around it, so what comes later stands. Phrases of two and more
    words don't count at the very end of a sentence.
    """
    n = len(tokens)
    read = sorted(
        (at, size, triggers[phrase])
        for size in {len(t) for t in triggers}
        for at, phrase in enumerate(zip(*(tokens[k:] for k in range(size)), strict=False))
        if phrase in triggers and (size == 1 or at + size < n)
    )
    reach = {"before": lambda first, last: (last, min(last + window, n)), "after": lambda first, last: (max(0, first - window), first)}
    lifts = [(k, at, at + size - 1) for k, (at, size, kind) in enumerate(read) if kind == "pseudo"]
    spans = [(k, *reach[kind](at, at + size - 1)) for k, (at, size, kind) in enumerate(read) if kind != "pseudo"]
    return [(lo, hi) for k, lo, hi in spans if not any(k < later and lo <= first and last <= hi for later, first, last in lifts)]


def windowed(sentences: Column | str, keywords: list[str], stem=None, triggers: dict[str, list[str]] | None = None, window: int = WINDOW) -> Column:
    """Struct array of (keyword, asserted, negated) flags under windowed negation: a keyword hits where any of its words stands, and is
    negated in a sentence if any hit lies in any scope. Runs in Arrow batches, as scopes depend on positions."""
    f = stem or (lambda w: w)
    t = triggers or {"before": list(BEFORE), "after": list(AFTER), "pseudo": list(PSEUDO)}
    table = trigger_table(*([" ".join(f(w) for w in p.split()) for p in t.get(kind, [])] for kind in ("before", "after", "pseudo")))
    sets = [frozenset(k.split()) for k in keywords]

    def one(sents) -> list[dict]:
        yes, no = [0] * len(sets), [0] * len(sets)
        for s in sents if sents is not None else ():
            words = list(s)
            held = set(words)
            hit = [k for k, ws in enumerate(sets) if ws & held]
            if not hit:
                continue
            denied = {words[i] for lo, hi in scopes(words, table, window) for i in range(lo, min(hi + 1, len(words)))}
            for k in hit:
                if sets[k] & denied:
                    no[k] = 1
                else:
                    yes[k] = 1
        return [{"keyword": k, "asserted": a, "negated": b} for k, a, b in zip(keywords, yes, no, strict=True)]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([one(s) for s in x], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<keyword: string, asserted: int, negated: int>>")(col(sentences))
