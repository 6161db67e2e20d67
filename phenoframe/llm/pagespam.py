"""Keyword-stuffed and link-list pages by the shapes of their lines (problem 10)."""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.session import spread

URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
ANCHOR, BLANK, TOKEN = re.compile(r"<a\s", re.I), re.compile(r"\s"), re.compile(r"\S+")
#: What a line must hold to have a link at all: cheap to look for.
MAYBE_LINK = re.compile(r"https?:|www\.|<a\s|\]\(|\.[a-z]{2,10}/", re.I)
_HOST = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
ENDER = re.compile(r"""[.!?…][)\]"'”’»]*(?=\s|$)|[。！？｡．।؟۔։።]""")
#: Marks that part the entries of menus and lists.
BARS = re.compile(r"[|»›·•¦｜>]|\s[*/~–—-]+(?=\s)|\s{3,}")
COMMAS = re.compile(r"[,،、，;；]")
ITEM = re.compile(r"^\s*(?:[-*•·–—]|\(?\d{1,3}[.)])\s+")
PRICE = re.compile(r"(?:[$€£¥]\s?)?\d{1,5}[.,]\d{2}(?:\s?(?:[$€£¥]|usd|eur))?\s*$", re.I)
ARTICLE = re.compile(r"\b[A-Z]{2,5}[-#]?\d{4,}\b|#\d{4,}\b")
WORD = re.compile(r"\w+")
LABEL, DIGIT, JOINT = re.compile(r"^\s*[\w ]{1,20}:\s"), re.compile(r"\d"), re.compile(r"(?<=\w)[-_+](?=\w)")
DOSE = re.compile(r"\d\s*(?:mg|g|mcg|µg|ml|mmol|units?|iu|%)\b", re.I)
#: A page is flagged when at least MOST of its characters lie in non-sentence lines of at most SHAPES shapes.
MOST, SHAPES = 0.5, 4
#: The share of a line's words that its commonest one has in stuffed text; in sentences even articles stay well below.
STUFFED = 0.15


def links(line: str) -> list[tuple[int, int]]:
    """Where links are: HTML anchors, [text](target), addresses with a scheme or www, and hosts with a path. Each kind is read once from left to right, so that a long line takes no longer than its length."""
    low, found = line.lower(), []
    at = 0
    for m in ANCHOR.finditer(line):
        if m.start() < at:
            continue
        end = low.find("</a>", m.end())
        if end < 0:
            break
        at = end + 4
        found.append((m.start(), at))
    before, mid, end, blank = 0, line.find("]("), 0, 0  # end, blank: the next bracket and the next blank from mid on
    while mid >= 0:
        if end < mid + 2 and (end := line.find(")", mid + 2)) < 0:
            break
        if blank < mid + 2:
            m = BLANK.search(line, mid + 2)
            blank = m.start() if m else len(line)
        start = line.rfind("[", before, mid)
        if start >= 0 and mid + 2 < end < blank and line.find("]", start, mid) < 0:
            found.append((start, end + 1))
        before = mid + 2
        mid = line.find("](", before)
    found += [m.span() for m in URL.finditer(line)]
    for m in TOKEN.finditer(low):
        host = m[0].partition("/")[0]
        if len(host) < len(m[0]) and (dot := host.rfind(".")) > 0 and host[dot + 1 :].isalpha() and host[dot + 1 :].isascii() and 2 <= len(host) - dot - 1 <= 10 and host[dot - 1] in _HOST:
            found.append((m.start() + len(host[:dot].rstrip("abcdefghijklmnopqrstuvwxyz0123456789.-")), m.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def without(line: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(line[at:a])
        at = b
    return " ".join([*out, line[at:]])


def _size(n: int) -> str:
    return "1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10+"


def _caps(words: list[str]) -> str:
    letters = [w for w in words if w[:1].isalpha()]
    up = sum(w[0].isupper() for w in letters)
    return "none" if not up else "most" if up > 0.7 * len(letters) else "some"


def _stuffed(words: list[str], enders: int) -> bool:
    """Few words over and over: one makes up STUFFED of the line, be it cut into would-be sentences, or most words recur and no sentence ends."""
    run = Counter(w.lower().strip(".,;:!?()\"'") for w in words)
    top, n = run.most_common(1)[0]
    if len(words) >= 20 and len(top) > 3 and n >= STUFFED * len(words) and len(run) <= 0.6 * len(words):
        return True
    return enders <= len(words) // 25 and len(run) <= 0.4 * len(words)


def _tags(tokens: list[str]) -> bool:
    n = sum(t[0] == "#" and len(t) > 1 for t in tokens)
    return n > 0 and n >= (0.6 if n >= 3 else 1) * len(tokens)


def _chains(tokens: list[str]) -> bool:
    n = sum(t.count("-") + t.count("_") + t.count("+") >= 2 and len(JOINT.findall(t)) >= 2 for t in tokens)
    return n >= 3 and n >= 0.4 * len(tokens)


def _brief(parts: list[str]) -> bool:
    return sum(len(p) <= 44 and len(p.split()) <= 5 for p in parts) >= 0.9 * len(parts)


def line_shape(line: str) -> tuple[str, str]:
    """The kind of a line and its shape: kind, length, capitals, separators, links. Kinds other than sentence, entry and short are non-sentence kinds."""
    linked = links(line) if MAYBE_LINK.search(line) else []
    bare = without(line, linked) if linked else line
    words = bare.split()
    enders = len(ENDER.findall(bare))
    kind = "sentence"
    bars = [p for p in BARS.split(ITEM.sub("", bare)) if p.strip()]
    commas = [p for p in COMMAS.split(LABEL.sub("", bare)) if p.strip()]
    if linked and len(words) <= 8 * len(linked) and (enders == 0 or len(words) <= 3 * len(linked)):
        kind = "links"
    elif "#" in line and _tags(line.split()):
        kind = "tags"
    elif ("-" in line or "_" in line or "+" in line) and _chains(line.split()):
        kind = "chains"
    elif ARTICLE.search(bare) and PRICE.search(bare):
        kind = "goods"
    elif len(bars) >= 4 and enders <= len(bars) // 8 and _brief(bars) and sum(DIGIT.search(p) is not None for p in bars) <= 0.4 * len(bars):
        kind = "menu"
    elif len(commas) >= 6 and enders <= len(commas) // 8 and _brief(commas):
        kind = "list"
    elif len(words) >= 12 and _stuffed(words, enders):
        kind = "repeats"
    elif ITEM.match(line) or "\t" in line.strip() or len(words) <= 8 and DOSE.search(bare):
        kind = "entry"
    elif len(words) <= 7 and not enders:
        kind = "short"
    elif not enders and len(words) >= 12 and not any(c in bare for c in ",;:،、") and max((len(w) for w in words), default=0) <= 20 and _caps(words) == "most":
        kind = "list"
    shape = "/".join((kind, _size(max(len(words), 1)), _caps(words), "bars" if len(bars) > 2 else "commas" if len(commas) > 3 else "plain", "link" if linked else "text"))
    return kind, shape


#: Distinct words over all words up to which the phrases of lists are keywords over and over; the items of a genuine list are mostly distinct.
DISTINCT = 0.7


def _lines(text: str) -> list[str]:
    return [x for x in (y.strip() for y in re.split("[\n\r\v\f\x85\u2028\u2029]+", text)) if x]


def _recurring(lines: Iterable[str]) -> bool:
    """Whether the words of lines recur so much that few of them are distinct. Scripts without blanks are taken by their marks between phrases."""
    words = [w for x in lines for w in WORD.findall(x.lower())]
    return len(set(words)) <= DISTINCT * len(words) if words else False


def page_shapes(text: str | None) -> tuple[float, float, str]:
    """Share of the characters that non-sentence lines hold, share that the page's commonest such shapes hold, and the shapes."""
    lines = _lines(text or "")
    total = sum(map(len, lines))
    if not total:
        return 0.0, 0.0, ""
    found = [(x, *line_shape(x)) for x in lines]
    short = Counter(x.lower() for x, kind, _ in found if kind == "short")
    n_short = sum(short.values())
    stuffed = n_short >= 5 and len(short) <= 0.4 * n_short or n_short >= 8 and _recurring(x for x, kind, _ in found if kind == "short")
    listed = _recurring(x for x, kind, _ in found if kind == "list")
    held: Counter[str] = Counter()
    for x, kind, shape in found:
        if kind not in ("sentence", "entry", "short", "list") or kind == "short" and stuffed or kind == "list" and listed:
            held[shape] += len(x)
    few = sum(n for _, n in held.most_common(SHAPES))
    return sum(held.values()) / total, few / total, " ".join(s for s, _ in held.most_common(SHAPES))


_OUT = "spam_share double, few_share double, shapes string, flagged boolean"


def flag_pages(df: DataFrame, text: str, most: float = MOST) -> DataFrame:
    """df with page_shape: a struct of spam_share, few_share, shapes and flagged.

    Each line becomes a shape; a page is flagged when lines of a few non-sentence shapes (menus, link lists, tag lists, keyword chains, goods, lists of
    phrases, a few phrases over and over) hold more than the share `most` of its characters. Null, empty and blank texts are not flagged. Whole texts are read,
    rows are judged one by one, so repeated rows agree; all columns stay. An empty table gives an empty result.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [page_shapes(x if isinstance(x, str) else None) for x in s]
            out = pd.DataFrame(got, columns=["spam_share", "few_share", "shapes"])
            out["flagged"] = out["few_share"] > most
            yield out

    shaped = F.pandas_udf(run, _OUT).asNondeterministic()  # else a filter on the outcome would run before the rows are spread
    return spread(df).withColumn("page_shape", shaped(F.col(text)))


def shape_report(flagged: DataFrame) -> DataFrame:
    """For each shape among the pages' commonest: pages that have it, and those of them that are flagged: shape, n_pages, n_flagged."""
    x = flagged.select(F.explode(F.split("page_shape.shapes", " ")).alias("shape"), F.col("page_shape.flagged").alias("f")).where("shape <> ''")
    return x.groupBy("shape").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("f").cast("long")).alias("n_flagged"))
