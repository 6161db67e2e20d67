"""Note cleaning and text features as Column functions: all run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steps(c: Column | str, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, col(c))


def clean_standard(c: Column | str) -> Column:
    """Delete all but ASCII letters, digits, blanks, line feeds and full stops; collapse white space; trim; lower case.

    Characters are deleted, not replaced: what stood between two words then joins them.
    """
    return F.lower(F.trim(steps(c, (r"[^A-Za-z0-9 \n.]", ""), (r"\s+", " "))))


def clean_spaced(c: Column | str) -> Column:
    """The variant that spaces marks out: w/ written out, brackets and slashes to blanks, a blank after full stops; keeps capitals."""
    return F.trim(steps(c, (r"\bw/\b", " with "), (r"\bw/o\b", " without "), (r"[:;()\[\]\\/]", " "), (r"\.", ". "), (r"[^A-Za-z0-9 \n.]", ""), (r"\s+", " ")))


def unify_terms(c: Column | str, *terms: tuple[str, str]) -> Column:
    """Standard cleaning, then one name for each of the given patterns."""
    return steps(clean_standard(c), *terms)


def ascii_words(c: Column | str) -> Column:
    """Lower case without non-ASCII characters, digits and punctuation."""
    return F.trim(steps(F.lower(col(c)), (r"[^\x00-\x7F]", ""), (r"\s+", " "), (r"[0-9]", ""), (r"[!-/:-@\[-`{-~]", ""), (r"\s+", " ")))


def content_filter(words: Column, stop: list[str], keep: list[str], least: int = 3) -> Column:
    """Words without stop words and without those shorter than `least`, but with those in keep."""
    return F.filter(words, lambda w: ~w.isin(*stop) & ((F.length(w) >= least) | w.isin(*keep)) & (w != ""))


def content_words(c: Column | str, stop: list[str], keep: list[str], least: int = 3) -> Column:
    """ascii_words that content_filter leaves; a blank where none is left."""
    joined = F.array_join(content_filter(F.split(ascii_words(c), " "), stop, keep, least), " ")
    return F.when(joined == "", F.lit(" ")).otherwise(joined)


def dedup_words(c: Column | str) -> Column:
    """A word that follows itself goes, as often as it does."""
    return F.regexp_replace(col(c), r"\b(\w+)( \1\b)+", "$1")


def literals(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


_LETTERS_ONLY = ((r"\d+", ""), (r"/l", " "), (r"[^A-Za-z0-9 \n.]", " "), (r"\.", " "), (r"\s+", " "))


def without_words(c: Column | str, stop: list[str]) -> Column:
    """The words of a text but for stop words, with one blank between them and none twice in a row."""
    if not stop:
        return F.trim(dedup_words(steps(c, (r"\s+", " "))))
    words = F.filter(F.split(F.trim(steps(c, (r"\s+", " "))), " "), lambda w: ~w.isin(*stop) & (w != ""))
    return F.trim(dedup_words(F.array_join(words, " ")))


def clean_scored(c: Column | str, before: list[tuple[str, str]], numbers: list[tuple[str, str]], after: list[tuple[str, str]], stop: list[str] = (), remove: list[tuple[str, str]] = ()) -> Column:
    """Cleaning for scored scales: lower case, literal replacements, numbers to phrases (whatever the case), then no digits or marks, no word twice in a row, the
    replacements and removals of what names the score, no stop words, and again no word twice in a row."""
    x = steps(literals(F.lower(col(c)), before), *((f"(?i){p}", r) for p, r in numbers), *_LETTERS_ONLY)
    return without_words(literals(dedup_words(x), [*after, *remove]), list(stop))


def clean_graded(c: Column | str, before: list[tuple[str, str]], numbers: list[tuple[str, str]], after: list[tuple[str, str]], stop: list[str] = (), remove: list[tuple[str, str]] = ()) -> Column:
    """The variant with another order: white space collapses first and commas go before numbers become phrases (in lower case), abbreviations are spelt out (after)
    only when digits and doubled words are gone, and then the removals."""
    x = steps(literals(steps(F.lower(col(c)), (r"\s+", " ")), before), (",", " "), (r"\s+", " "), *numbers, *_LETTERS_ONLY)
    return without_words(literals(literals(dedup_words(x), after), remove), list(stop))


def matches(c: Column | str, pattern: str) -> Column:
    """1 if the pattern occurs anywhere in the text, else 0 (null texts too)."""
    return F.coalesce(col(c).rlike(pattern).cast("int"), F.lit(0))


def any_phrase(c: Column | str, phrases: list[str]) -> Column:
    return F.coalesce(col(c).rlike("|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)), F.lit(False))


def ngram_count(c: Column | str, ngram: str) -> Column:
    """How often an n-gram stands in a text, not next to further letters; occurrences do not overlap."""
    return F.coalesce(F.regexp_count(col(c), F.lit(rf"(?<![a-z]){re.escape(ngram)}(?![a-z])".replace(r"\ ", " "))), F.lit(0))


def ngram_present(c: Column | str, ngram: str) -> Column:
    return (ngram_count(c, ngram) > 0).cast("int")


def pattern_count(c: Column | str, pattern: str) -> Column:
    """How often a pattern occurs between word bounds, whatever the case; 0 for a pattern that is none."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(0)
    return F.coalesce(F.regexp_count(col(c), F.lit(rf"(?i)\b(?:{pattern})\b")), F.lit(0))


def last_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group in the pattern's last occurrence; null without one."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.lit(-1))


def sentences(c: Column | str) -> Column:
    """Sentences of a cleaned text, in which only full stops end one: array of strings. Titles and single letters before a full stop do not end one."""
    guarded = F.regexp_replace(col(c), r"\b(dr|mr|mrs|ms|prof|vs|etc|e\.g|i\.e|approx|no|[a-z])\. ", "$1.\u0001")
    return F.transform(F.split(guarded, r"(?<=\.)\s+"), lambda s: F.replace(s, F.lit("\u0001"), F.lit(" ")))


def tokens(c: Column | str) -> Column:
    """Words of a cleaned sentence: the final full stop goes, contractions fall apart (cannot: can, not)."""
    x = steps(c, (r"\.+(\s|$)", " "), (r"\bcannot\b", "can not"), (r"\bgonna\b", "gon na"), (r"\bgotta\b", "got ta"), (r"\s+", " "))
    return F.filter(F.split(F.trim(x), " "), lambda w: w != "")


def sentence_tokens(c: Column | str) -> Column:
    """array<array<string>>: the words of each sentence."""
    return F.transform(sentences(c), lambda s: tokens(s))
