"""Sentence boundaries across languages and scripts (problem 7).

The rules are those of the standard's sentence breaks by character property - a terminator, its closing marks, the blanks
after it, then what follows decides - with abbreviations suppressed by language and quotations kept whole.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.session import spread

#: Terminators, by the standard's property: full stops (a wide one is none between CJK signs), and marks that end a sentence whatever follows.
_STOP, _MARK = r"[[\p{Sentence_Break=ATerm}…]--[．]]", r"[\p{Sentence_Break=STerm}．]"
#: Marks that need a blank or a capital after them to end one.
SPACED = "!?"
# Quotation marks by what closes them.
QUOTES = {"«": "»", "‹": "›", "“": "”", "„": "“”", "「": "」", "『": "』", "〝": "〞〟"}
_QUOTE = re.compile("[\"«»‹›“”„「」『』〝〞〟]")
NEWLINE = re.compile("\r\n|[\n\r\v\f\x85\u2028\u2029]")

# Abbreviations, without their last dot. After these a sentence goes on whatever follows ...
NEVER = frozenset(
    # English
    "dr mr mrs ms mx messrs prof rev hon gov pres capt cpt lt sgt col gen maj cmdr fr vs i.e e.g viz approx esp incl excl cf ref refs no nos tel fax ext fig figs vol vols pp ch sec eq ed eds repr resp dept univ est ave-no min-no wt ht temp "
    # German
    "med z.b d.h u.a u.u s.o s.u o.g i.d.r z.t z.zt v.a ca bzw vgl evtl ggf inkl exkl zzgl sog bspw hr fr nr str abs art bd mind höchst tägl wö "
    # French
    "m mm mme mlle mlles mmes p.ex env c.-à-d càd av apr bd chap éd réf tél "
    # Spanish, Portuguese, Italian
    "sr sra srta sres dra d.ª dña ud uds aprox pág núm n.º art av avda tlf tel.º ej p.ej sig dott sig.ra sigg ing avv ecc-no "
    # Russian and other Cyrillic
    "т.е т.к т.н напр ок см ул д г-н г-жа проф акад доц им стр рис табл тел ср пр пер кв обл р-н ст "
    # Arabic, Hindi, Hebrew, Greek
    "د أ م ص ج ت.ب डॉ श्री श्रीमती सुश्री प्रो पं मि.ग्रा मि.ली कि.ग्रा से.मी मि कि ग्रा उदा ד״ר פרופ κ κα δρ π.χ".split()
)
# ... and these may end a sentence: it goes on if what follows is not a capital.
EITHER = frozenset(
    "etc a.m p.m am pm inc ltd co corp jr sq max apt ph.d m.d d.o r.n b.sc m.sc u.s u.k u.s.a usw u.s.w std sek mio mrd tgl мин сек ч г гг вв в руб тыс млн млрд т.д т.п и.о кг мг мл см мм ملغ كغ سم إلخ".split()
)
#: Dosing schedules end a sentence too when a word follows that cannot continue one.
DOSING = frozenset("b.i.d t.i.d q.i.d q.d q.h.s h.s p.r.n q.o.d q.a.m q.p.m p.o i.v i.m s.c s.l bid tid qid prn min hr hrs wk wks mo yr yrs lb lbs oz ft mg ml kg cm mm mmhg".split())
CONTINUES = frozenset("in with for and or but until as to since after before while during via by through if-no per from of than then pending unless without plus minus x".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez januari".split())
#: Kinds of street, abbreviated: after a house number and names the sentence may end there.
STREET = frozenset("dr st rd ave av blvd ln ct pl pkwy hwy sq ter cir".split())
DOMAIN = frozenset("com org net edu gov mil int example test invalid local localhost info io de fr es ru cn jp in uk eu us html htm php pdf txt csv jpg png".split())

#: Words before a letter that names a kind, so that the letter is no initial; words that begin sentences and are no names.
KINDS = frozenset("vitamin hepatitis type grade stage class group plan protein factor category level option part appendix section figure table phase score influenza virus strain gene chromosome arm cohort schedule grupo typ klasse grad stadium groupe classe stade tipo grado гепатит гепатита витамин витамина тип группа".split())
STARTERS = frozenset("the this that these those it its he she we they you there here his her their our my no not in on at as if when while after before since for from with without and but or then also however please follow continue start stop see is was er sie es wir das der die il elle nous le la les el los ella он она мы это".split())
WEEKDAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun".split())
#: Words between which an initial stands rather than at a sentence's end.
BEFORE_NAMES = frozenset("by with and to from for of per dr mr mrs ms prof nurse doctor patient attending surgeon von und mit bei zu et par avec de y con por da und & и с к от".split())

_EVENT = regex.compile(rf"(?P<stop>{_STOP}+)|(?P<mark>{_MARK}+)|(?P<gap>(?<=\p{{Thai}})\s+(?=\p{{Thai}}))", regex.V1)
_CLOSING = regex.compile(r"[\p{Sentence_Break=Close}&&[\p{Pe}\p{Pf}]]", regex.V1)
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}.'’ªº״\-]*$")
_ITEM = regex.compile(r"\s*(?:[-–—*•·▪‣◦●○∙+]|\(?(\d{1,3}|[a-zA-Z])[.)])\s+\S")
_BULLET = regex.compile(r"\s*[-–—*•·▪‣◦●○∙+]\s")
_HEAD_END = (":", "：")
_ENDED = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…:：][\p{Sentence_Break=Close}]*\s*$")
_KANA = regex.compile(r"\p{Hiragana}")
_STREET = regex.compile(r"\d[\w-]*\s(?:[\p{Lu}][\p{L}'’.-]*\s){1,4}$")
_NO_CASE = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_DEVANAGARI = regex.compile(r"[\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}]")


@lru_cache(maxsize=4096)
def closes(c: str) -> bool:
    """Whether a character is a closing mark that belongs to the sentence before it."""
    return _CLOSING.fullmatch(c) is not None


def quotations(s: str) -> dict[int, int]:
    """Pairs of opening and closing places of quotation marks, nested ones too, however far apart; a mark without a partner is left out.

    A straight mark opens before a word that it does not follow, closes behind one that it does not precede, and else does what there is to do.
    """
    out: dict[int, int] = {}
    open_: list[tuple[int, str]] = []  # places and what closes them
    waiting: Counter[str] = Counter()  # how many open marks each closing mark has
    for m in _QUOTE.finditer(s):
        c, i = m[0], m.start()
        opens = QUOTES.get(c)
        if c == '"':
            before, after = s[i - 1 : i], s[i + 1 : i + 2]
            can_open, can_close = bool(after) and not after.isspace(), bool(before) and not before.isspace()
            strictly = can_open and (not before or before.isspace() or before in "([{«“„")
            opens = '"' if can_open and (strictly or not waiting['"']) else None
            if not opens and not can_close and not waiting['"']:
                continue
        if waiting[c] and (opens is None or c != '"'):
            while True:  # marks opened since then have no partner
                at, closing = open_.pop()
                waiting.subtract(closing)
                if c in closing:
                    break
            out[at] = i
        elif opens:
            open_.append((i, opens))
            waiting.update(opens)
    return out


def _outermost(pairs: dict[int, int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs.items()):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _abbreviated(before: str, after: str, token: str) -> bool | None:
    """Whether the dot after `token` belongs to it: True - the sentence goes on, False - it may end, None - no abbreviation."""
    t = token.strip("'’-").lower()
    nxt = after[:1]
    lower = nxt.islower()
    word = regex.match(r"[\p{L}\p{M}]+", after)
    if t in DOSING:
        return lower and word is not None and word[0].lower() in CONTINUES
    if len(t) == 1 and t.isalpha():
        if token.isupper():
            return not _kind_letter(before[: len(before) - len(token)], word[0] if word else "")
        if t in NEVER or lower or regex.match(r"\p{L}\.", after):
            return True
        return None
    if t in STREET and not _STREET.search(before[: len(before) - len(token)]) and t not in NEVER:
        return None
    if t in STREET and _STREET.search(before[: len(before) - len(token)]):
        return lower or not nxt.isalpha() or regex.match(r"[\p{L}-]+:", after) is not None
    if t in NEVER or regex.sub(r"\s", "", t) in NEVER:
        return True
    if t.endswith("str") and (nxt.isdigit() or lower):
        return True
    if t in EITHER:
        return lower or nxt.isdigit() or t in ("a.m", "p.m", "am", "pm") and word is not None and word[0].lower() in WEEKDAYS
    if t.isdigit():
        return len(t) <= 2 and word is not None and word[0].lower() in MONTHS
    if _DEVANAGARI.search(t):
        return "." in t or len(t) <= 3
    return None


def _kind_letter(before: str, following: str) -> bool:
    """Whether a single capital names a kind of something (vitamin B, hepatitis C) and what follows begins a sentence; else it is an initial."""
    last = regex.search(r"([\p{L}&]+)\s+$", before)
    if last is None or not following[:1].isupper():
        return False
    word = last[1].lower()
    return word in KINDS or last[1].islower() and word not in BEFORE_NAMES and following.lower() in STARTERS


def _dot_ends(s: str, i: int, j: int, k: int) -> bool:
    """Whether the full stop s[i:j], whose closing marks end at k, ends a sentence."""
    rest = s[k : k + 60]
    after = rest.lstrip()
    gap = len(rest) - len(after)
    token = _TOKEN.search(s[max(0, i - 40) : i])[0]
    before = s[max(0, i - 80) : i]
    ellipsis = j - i > 1 or s[i] == "…"
    if not after:
        return True
    nxt = after[0]
    if not gap and k == j:
        # a full stop without the blank after it
        if ellipsis or len(token) < 1 or not (nxt.isupper() or nxt.isalpha() and _lowered(s, i, j)):
            return False
        if "@" in s[max(0, i - 60) : i].rpartition(" ")[2] or not (token[-1].islower() or token[-1].isdigit()):
            return False
        whole = regex.match(r"[\p{L}\p{M}]+", after)[0]
        if nxt.isupper():
            known = _abbreviated(before, after, token)
            return known is not True and (len(whole) > 1 or after[1:2].isspace()) and (whole.isupper() or whole[1:].islower())
        return True
    if not gap and nxt in ",;:،؛、)]}-/–":
        return False
    if ellipsis:
        return not nxt.islower()
    if token and _NO_CASE.search(token[-1]):
        return False
    if not gap:
        return True
    if nxt in ",;:":
        return False
    known = _abbreviated(before, after, token)
    if known is not None:
        return not known
    return True


def _lowered(s: str, i: int, j: int) -> bool:
    """Whether letters on both sides of a dot without blanks look like two words, not like an address or a file."""
    left, right = regex.search(r"\S*$", s[max(0, i - 80) : i])[0], regex.match(r"\S*", s[j : j + 80])[0]
    if regex.search(r"[@/\\_:]|\(at\)|\[at\]|www|\.", left + right.rstrip(".,;:!?)\"'")) or s[max(0, i - 40) : i].rstrip().endswith("@"):
        return False
    if regex.match(r"\S*\s*(?:@|[(\[{<]\s*at\s*[)\]}>])", s[j : j + 80], regex.I):
        return False
    a, b = regex.search(r"\p{L}*$", left)[0], regex.match(r"\p{L}*", right)[0]
    behind = s[max(0, i - len(left) - 3) : i - len(left)].rstrip()
    return len(a) > 2 and len(b) > 1 and b.lower() not in DOMAIN and not behind.endswith(("@", ")", "]")) and a == left and regex.fullmatch(r"[\p{L}'’]+[.,;:!?]?", right) is not None


def _ends(s: str) -> Iterator[int]:
    """Places in a paragraph after which a new sentence begins."""
    pairs = quotations(s)
    ends = {b for b in pairs.values()}
    inside = _outermost(pairs)
    at = first = 0

    def closing(k: int) -> int:
        while k < len(s):
            if closes(s[k]) and not (s[k] in "”“" and k in pairs) or k in ends:
                k += 1
            elif s[k].isspace() and (m := re.match(r"\s+([»›])", s[k : k + 4])) and k + m.end() - 1 in ends:
                k += m.end()
            else:
                break
        return k

    for m in _EVENT.finditer(s):
        i, j = m.span()
        if i < at:
            continue
        while first < len(inside) and inside[first][1] < i:
            first += 1
        quote = inside[first] if first < len(inside) and inside[first][0] < i <= inside[first][1] else None
        if m.lastgroup == "gap":
            if quote is None:
                yield i
            continue
        if quote is not None:
            rest = s[j : quote[1]]
            if rest.strip() and not all(closes(c) for c in rest.strip()):
                continue  # within a quotation nothing ends
            k = closing(quote[1])
            after = s[k : k + 80].lstrip()
            at = k
            if not after:
                yield k
            elif _KANA.match(s[k : k + 1]) or after[0] in ".,;:!?。、，；" or after[0].islower():
                continue
            else:
                yield k
            continue
        k = closing(j)
        mark = m[0]
        if m.lastgroup == "stop":
            if _dot_ends(s, i, j, k):
                yield k
        elif mark[-1] in SPACED:
            nxt = s[k : k + 1]
            if not nxt or nxt.isspace() or nxt.isupper() or ord(nxt) > 0x2E80 or nxt in "¿¡\"'“«„(":
                yield k
        else:
            if s[k : k + 1] in ("」", "』", "”") or mark[-1] in "．" and s[k : k + 1].isdigit():
                continue
            yield k
        at = max(at, k)


def _lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in NEWLINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit in a text, in order, ends exclusive, without blanks at either side.

    Blank lines end a unit; a heading line that ends in a colon, and a list item (dash, star, number) are units of their own; other
    line breaks are blanks.
    """
    blocks: list[tuple[int, int, bool]] = []  # start, end, whole
    begin = end = -1
    item = number = None

    def flush() -> None:
        nonlocal begin, end, item
        if begin >= 0:
            blocks.append((begin, end, item is not None))
        begin, item = -1, None

    lines = list(_lines(text))
    for x, (a, b) in enumerate(lines):
        line = text[a:b]
        bare = line.strip()
        if not bare:
            flush()
            number = None
            continue
        fresh = begin < 0
        ended = fresh or bool(_ENDED.search(text[max(begin, end - 60) : end]))
        m = _ITEM.match(line)
        if m:
            n = m[1]
            if n is None:
                ok = fresh or item is not None or ended
            elif n.isdigit():
                ok = (number is not None and int(n) == number + 1 and item is not None) or (int(n) in (0, 1) and ended) or fresh and _list_goes_on(text, lines, x, int(n))
            else:
                ok = fresh and n in "aA" or item is not None and number is not None and ord(n) == number + 1
            if ok:
                flush()
                number = None if n is None else int(n) if n.isdigit() else ord(n)
                begin, end, item = a, b, True
                continue
        if bare.endswith(_HEAD_END) and (ended or item) and len(bare) <= 80 and len(bare.split()) <= 8 and not regex.search(r"[.!?。！？।][\s\"]", bare[:-1]):
            nxt = text[b:].lstrip()[:1]
            if nxt not in QUOTES and nxt != '"':
                flush()
                blocks.append((a, b, True))
                number = None
                continue
        if item is not None and (ended or bare[:1].isupper()):
            flush()
        if begin < 0:
            begin = a
        end = b
    flush()
    out = []
    for a, b, whole in blocks:
        s = text[a:b]
        at = 0
        for k in [*([] if whole else _ends(s)), len(s)]:
            part = s[at:k]
            bare = part.strip()
            if bare:
                lead = len(part) - len(part.lstrip())
                out.append((a + at + lead, a + at + lead + len(bare)))
            at = max(at, k)
    return out


def _list_goes_on(text: str, lines: list[tuple[int, int]], x: int, n: int) -> bool:
    """Whether a numbered line at the start of a paragraph has a neighbour with the next number, or is number one."""
    if n in (0, 1):
        return True
    for a, b in lines[x + 1 : x + 2]:
        m = _ITEM.match(text[a:b])
        return bool(m and m[1] and m[1].isdigit() and int(m[1]) == n + 1)
    return False


def split_sentences(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per sentence unit: ident, start_pos, end_pos (characters from 0, ends exclusive).

    Null, empty and blank texts have no units. Texts are read whole; a text without any terminator is one unit for each paragraph. Rows are taken one by one: a repeated
    row gives its units again, a null id is kept. Other columns of df don't matter. An empty table gives an empty result.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[{"start_pos": a, "end_pos": b} for a, b in units(x)] if isinstance(x, str) else [] for x in s], dtype=object)

    found = F.pandas_udf(run, "array<struct<start_pos: long, end_pos: long>>")
    rows = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()))
    return rows.select("_id", F.explode(found("_text")).alias("u")).select(F.col("_id").alias(ident), "u.start_pos", "u.end_pos")
