"""Replacing personal values in free text by placeholders or by keyed surrogates (problem 3)."""

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.llm import pii
from phenoframe.session import cut, spread

#: Letters of made-up names by script: onsets and vowels of two-letter syllables, or single signs.
_SYLLABLES = {
    "LATIN": ("b d f g k l m n p r s t v z br tr kl".split(), "a e i o u".split()),
    "CYRILLIC": ("б в г д з к л м н п р с т".split(), "а е и о у".split()),
    "GREEK": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split()),
    "ARABIC": ("ب ت ج د ر س ف ك ل م ن".split(), "ا و ي".split()),
    "HEBREW": ("ב ג ד ל מ נ ק ר ש".split(), "א ו י".split()),
    "DEVANAGARI": ("क ग त द न प म र ल व स".split(), ["ा", "ी", "े", "ो"]),
    "THAI": ("ก ข จ ต น บ ป ม ร ล ส".split(), ["า", "ี", "ู"]),
    "CJK": (list("安白川東田林石高水木山原"), list("一文明正和光")),
    "HIRAGANA": (list("あかさたなはまやら"), list("きしみりん")),
    "KATAKANA": (list("アカサタナハマヤラ"), list("キシミリン")),
    "HANGUL": (list("김이박최정강조윤장임"), list("민서준현지우")),
}
# Titles that tell a gender.
_SHE = re.compile(r"\b(?:mrs|ms|miss|mme|mlle|frau|sra|srta|señora|señorita|madame|lady|madre|mother|sister|wife|daughter|niece|aunt|grandmother|госпожа|г-жа)\b\.?,?\s*$", re.I)
_HE = re.compile(r"\b(?:mr|m|monsieur|herr|herrn|sr|señor|don|sir|lord|father|brother|husband|son|nephew|uncle|grandfather|господин|г-н)\b\.?,?\s*$", re.I)
_SHE_END, _HE_END = {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}, {"LATIN": "o", "CYRILLIC": "ин", "GREEK": "ος"}


def script(word: str) -> str:
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "LATIN").split()[0]
            return name if name in _SYLLABLES else "LATIN"
    return "LATIN"


def _stream(secret: bytes, *parts: object) -> Iterator[int]:
    """Keyed numbers below 2**16, without end."""
    k = 0
    while True:
        h = hmac.new(secret, "\x1f".join(map(str, (*parts, k))).encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(h[i : i + 2], "big") for i in range(0, 32, 2))
        k += 1


def name_token(secret: bytes, token: str, gender: str, attempt: int) -> str:
    """A made-up name in the token's script; lower case. Later attempts give longer ones, so that there are enough for any number of tokens."""
    kind = script(token)
    onset, vowel = _SYLLABLES[kind]
    draw = _stream(secret, "name", token, attempt)
    if kind in ("CJK", "HANGUL"):  # one sign is a syllable
        signs = [*onset, *vowel]
        return onset[next(draw) % len(onset)] + "".join(signs[next(draw) % len(signs)] for _ in range(1 + attempt))
    n = (2 if kind in ("HIRAGANA", "KATAKANA") else 3 + next(draw) % 2) + attempt // 2
    word = "".join(onset[next(draw) % len(onset)] + vowel[next(draw) % len(vowel)] for _ in range(n))
    end = {"f": _SHE_END, "m": _HE_END}.get(gender, {}).get(kind)
    return word[:-1] + end if end else word + (onset[next(draw) % 12 % len(onset)][-1] if kind == "LATIN" else "")


def permuted(secret: bytes, digits: str, what: str) -> str:
    """Another string of as many digits: a keyed Feistel permutation of all of them, so that distinct strings stay distinct."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + next(_stream(secret, what, n)) % 9 + 1) % 10) if digits else digits
    h = n // 2
    left, right = digits[:h], digits[h:]
    for r in range(6):  # an even number of rounds keeps the halves' lengths
        a, b = (left, right) if r % 2 == 0 else (right, left)
        f = int(hmac.new(secret, f"{what}|{n}|{r}|{b}".encode(), hashlib.sha256).hexdigest()[:16], 16)
        a = str((int(a) + f) % 10 ** len(a)).zfill(len(a))
        left, right = (a, right) if r % 2 == 0 else (left, a)
    return left + right


def house(secret: bytes, digits: str) -> str:
    """Another number of as many digits: the keyed permutation, walked on until a leading zero is there as before, so that distinct numbers stay distinct."""
    digits = "".join(str(int(c)) for c in digits)
    new = permuted(secret, digits, "house")
    while (new[0] == "0") != (digits[0] == "0"):
        new = permuted(secret, new, "house")
    return new


@lru_cache
def _letters() -> dict[str, tuple]:
    """The alphabet of each letter in lower case: its script, whether it is a plain letter of it and whether it has a capital of its own."""
    out = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalpha() and c.lower() == c:
            up = c.upper()
            out[c] = (unicodedata.name(c, "LATIN").split()[0], c.isascii() or "α" <= c <= "ω" or "а" <= c <= "я", up != c and len(up) == 1 and up.lower() == c)
    return out


@lru_cache(maxsize=512)
def _ring(secret: bytes, alphabet: tuple) -> dict[str, str]:
    """Each letter of an alphabet with the next one in a keyed order: a bijection that leaves no letter as it is (but of an alphabet of one)."""
    order = sorted((c for c, a in _letters().items() if a == alphabet), key=lambda c: hmac.new(secret, f"initial|{c}".encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def initial(secret: bytes, letter: str) -> str:
    """The surrogate of a single letter, one of its alphabet and case: distinct initials stay distinct."""
    low = letter.lower()
    if low not in _letters():
        return letter
    new = _ring(secret, _letters()[low])[low]
    return new.upper() if low != letter and len(new.upper()) == 1 else new


def in_digits(secret: bytes, value: str, what: str, keep: int = 0) -> str:
    """value with its digits (but the first `keep`) permuted and its letters shifted by place, in its format."""
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    new = iter(digits[:keep] + permuted(secret, digits[keep:], what))
    shift = _stream(secret, what, "letters")
    out = []
    for c in value:
        if c.isdecimal():
            out.append(next(new))
        elif "A" <= c.upper() <= "Z":
            base = ord("A" if c.isupper() else "a")
            out.append(chr(base + (ord(c) - base + 1 + next(shift) % 25) % 26))
        else:
            out.append(c)
    return "".join(out)


def cased(model: str, word: str) -> str:
    if len(model) > 1 and model.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# The codes of countries that have two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PARTS = regex.compile(rf"^(?P<local>.*?){pii._AT}(?P<domain>.*)$", regex.I | regex.S)
_DOTS = regex.compile(pii._DOT, regex.I)


def kept_digits(value: str) -> int:
    """How many leading digits of a telephone number are not its own: the international prefix and the country's code, or a trunk zero."""
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    bare = value.lstrip("( ")
    if bare.startswith("+") or digits.startswith("00"):
        lead = 0 if bare.startswith("+") else 2
        code = digits[lead:]
        return lead + (1 if code[:1] in ("1", "7") else 2 if code[:2] in _TWO_DIGITS else 3)
    return 1 if digits[:1] == "0" or len(digits) == 11 and digits[0] == "1" else 0


def email_parts(value: str) -> tuple[str, list[str]]:
    """The local part, and the labels of the domain but the last (the top-level one)."""
    m = _PARTS.match(value)
    return (m["local"], _DOTS.split(m["domain"])[:-1]) if m else (value, [])
_FIXED_ADDRESS = frozenset(f"{pii._EN}|{pii._PRE}|{pii._FR}|north|south|east|west|old|new|upper|lower|great|little|n|s|e|w|ne|nw|se|sw|de|del|la|las|los|des|du|l|d|a|b|c|apt|bis|no".lower().split("|")) | {"ул", "улица", "д", "дом", "شارع"}


def tokens_of(kind: str, value: str) -> list[str]:
    """The words in a mention that get surrogates of their own, lower case, so that parts of a name stay recognisable as such; initials are permuted instead."""
    if kind == "name":
        return [t.lower() for t in _TOKEN.findall(value) if len(t) > 1]
    if kind == "address":
        ends = re.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|ring|ufer|damm)$")
        return [ends.sub("", t.lower()) for t in _TOKEN.findall(value) if t.lower() not in _FIXED_ADDRESS and ends.sub("", t.lower())]
    if kind == "email":
        local, labels = email_parts(value)
        return [local.lower(), *("@" + x.lower() for x in labels)]
    return []


def surrogate(secret: bytes, kind: str, value: str, words: dict[str, str]) -> str:
    """The replacement of a mention in its format; words maps the tokens of tokens_of."""
    if kind == "name":
        return _TOKEN.sub(lambda m: initial(secret, m[0]) if len(m[0]) == 1 else cased(m[0], words.get(m[0].lower(), "x")), value)
    if kind == "phone":
        return in_digits(secret, value, "phone", kept_digits(value))
    if kind == "id_number":
        return in_digits(secret, value, "id")
    if kind == "address":
        def word(m: re.Match) -> str:
            t = m[0].lower()
            if t in _FIXED_ADDRESS:
                return m[0]
            end = re.search(r"(?:straße|strasse|str|gasse|weg|platz|allee|ring|ufer|damm)$", t)
            stem = t[: end.start()] if end else t
            return cased(m[0], words.get(stem, "x") if stem else "") + (m[0][end.start() :] if end and stem else m[0] if not stem else "")

        return re.sub(r"\d+", lambda m: house(secret, m[0]), _TOKEN.sub(word, value))
    local, labels = email_parts(value)
    new = words.get(local.lower(), "x")
    out, at = [new.upper() if local.isupper() else new], len(local)
    for label in labels:
        to = value.index(label, at)
        out += [value[at:to], words.get("@" + label.lower(), "x")]
        at = to + len(label)
    return "".join(out) + value[at:]


_SPANS = "array<struct<kind: string, start_pos: long, end_pos: long, value: string, gender: string>>"


def _found(text: str) -> list[dict]:
    out = []
    for m in pii.find(text):
        before = text[max(0, m.start - 24) : m.start]
        out.append({"kind": m.kind, "start_pos": m.start, "end_pos": m.end, "value": text[m.start : m.end], "gender": ("f" if _SHE.search(before) else "m" if _HE.search(before) else "u") if m.kind == "name" else ""})
    return out


def mentions(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per mention of a personal value: ident, kind, start_pos, end_pos (characters from 0, end exclusive), value, gender.

    Null, empty and blank texts have no mentions; texts are read whole. Repeated rows give their mentions again, null ids are kept, other columns don't matter.
    An empty table gives an empty result.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([_found(x) if isinstance(x, str) else [] for x in s], dtype=object)

    rows = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()))
    return rows.select("_id", F.explode(F.pandas_udf(run, _SPANS)("_text")).alias("m")).select(F.col("_id").alias(ident), "m.*")


def redact(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a column `out`: the text with each personal value replaced by a placeholder of its type ([NAME], [PHONE], ...), all else as it was.

    Null stays null, empty stays empty. All rows and columns stay; a column already named `out` is an error.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists already")

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([_replaced(x, [(m.start, m.end, f"[{m.kind.upper()}]") for m in pii.find(x)]) if isinstance(x, str) else None for x in s], dtype=object)

    return spread(df).withColumn(out, F.pandas_udf(run, "string")(F.col(text)))


def _replaced(text: str, new: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, x in sorted(new):
        out += [text[at:a], x]
        at = b
    return "".join([*out, text[at:]])


def surrogate_words(found: DataFrame, secret: str, most_rounds: int = 12) -> DataFrame:
    """The keyed, distinct surrogate of each word of names, addresses and e-mail local parts: kind, token, word.

    A word keeps its surrogate in all texts (coreference). Two checks keep surrogates distinct and strange to the corpus: where two words drew the same
    surrogate the lesser word keeps it and the others draw again, and no surrogate may be a word that the corpus has as a personal one. The check runs over all words by a
    shuffle on the surrogate, round by round, until no word is left; e-mail parts also serve as logins and are drawn from the same pool of names.
    """
    key = secret.encode()

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            got = [(k, t, g) for k, v, g in zip(d["kind"], d["value"], d["gender"], strict=True) for i, t in enumerate(tokens_of(k, v)) for g in [g if i == 0 else ""]]
            yield pd.DataFrame(got, columns=["kind", "token", "gender"])

    all_ = found.select("kind", "value", "gender").distinct().mapInPandas(words, "kind string, token string, gender string")
    # of several titles' genders the commonest first in order f, m, u; e-mail parts have none
    todo = cut(all_.withColumn("pool", F.when(F.col("kind") == "email", "email").otherwise("name")).groupBy("pool", "token").agg(F.min(F.when(F.col("gender").isin("f", "m"), F.col("gender"))).alias("gender")).na.fill("u"))
    real = todo.select("pool", F.col("token").alias("word"))
    done = None
    for attempt in range(most_rounds):

        def draw(parts: Iterator[pd.DataFrame], attempt: int = attempt) -> Iterator[pd.DataFrame]:
            for d in parts:
                new = []
                for p, t, g in zip(d["pool"], d["token"], d["gender"], strict=True):
                    w = name_token(key, t, g, attempt)
                    if t.startswith("@"):
                        w = name_token(key, t, "u", attempt)
                    elif p == "email":
                        tail = next(_stream(key, "tail", t, attempt)) % 100
                        w = re.sub(r"[^a-z]", "", w) or "user"
                        w = f"{w}.{name_token(key, t + '#', 'u', attempt)}{tail}" if script(t) == "LATIN" else f"user{tail}"
                    new.append(w)
                yield d.assign(word=new)

        tried = todo.mapInPandas(draw, "pool string, token string, gender string, word string").join(real, ["pool", "word"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("pool", "word"), ["pool", "word"], "left_anti")
        won = tried.groupBy("pool", "word").agg(F.min("token").alias("token"))
        done = cut(won if done is None else done.unionByName(won))
        todo = cut(todo.join(done.select("pool", "token"), ["pool", "token"], "left_anti"))
        if todo.isEmpty():
            return done
    raise RuntimeError(f"{todo.count()} words are still without a distinct surrogate after {most_rounds} rounds")


def replacements(df: DataFrame, ident: str, text: str, secret: str) -> DataFrame:
    """One row per mention of a personal value with what replaces it: ident, kind, start_pos, end_pos, value, surrogate.

    Equal values get equal surrogates in all texts and distinct values distinct ones: words of names, addresses and e-mail addresses (their domains included, but
    for the top-level one) by surrogate_words, numbers and initials by a keyed permutation. Of telephone numbers the digits behind prefix and country code are permuted,
    so that one number keeps one surrogate in all its formats. Who holds the secret can repeat the mapping; without it the surrogates tell nothing. Mentions are those of
    `mentions`, whose cases hold here too.
    """
    found = cut(mentions(df, ident, text).withColumnRenamed(ident, "_id"))
    words = surrogate_words(found, secret)
    key = secret.encode()

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            got = [(k, v, "email" if k == "email" else "name", t) for k, v in zip(d["kind"], d["value"], strict=True) for t in tokens_of(k, v) or [""]]
            yield pd.DataFrame(got, columns=["kind", "value", "pool", "token"])

    pieces = found.select("kind", "value").distinct().mapInPandas(split, "kind string, value string, pool string, token string")
    mapped = pieces.join(words, ["pool", "token"], "left").groupBy("kind", "value").agg(F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("word", F.lit(""))))).alias("words"))

    def replace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            yield d.assign(surrogate=[surrogate(key, k, v, dict(w)) for k, v, w in zip(d["kind"], d["value"], d["words"], strict=True)])[["kind", "value", "surrogate"]]

    new = mapped.mapInPandas(replace, "kind string, value string, surrogate string")
    return found.join(new, ["kind", "value"]).select(F.col("_id").alias(ident), "kind", "start_pos", "end_pos", "value", "surrogate")


def surrogates(df: DataFrame, ident: str, text: str, out: str, secret: str) -> DataFrame:
    """ident and `out`: the text with each personal value replaced by a keyed surrogate of its type, gender, script and format (see replacements).

    Null texts stay null; rows must have distinct non-null ids (an error otherwise is
    not raised: of rows with one id one comes out). An empty table gives an empty result.
    """
    made = replacements(df, ident, text, secret).withColumnRenamed(ident, "_id")
    spans = made.groupBy("_id").agg(F.collect_list(F.struct("start_pos", "end_pos", F.col("surrogate").alias("new"))).alias("_spans"))

    def rebuild(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for d in parts:
            yield pd.Series([t if t is None or s is None else _replaced(t, sorted({(x["start_pos"], x["end_pos"], x["new"]) for x in s})) for t, s in zip(d["_text"], d["_spans"], strict=True)], dtype=object)

    texts = df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull()).dropDuplicates(["_id"])
    both = texts.join(spans, "_id", "left")
    return both.select(F.col("_id").alias(ident), F.pandas_udf(rebuild, "string")(F.struct("_text", "_spans")).alias(out))


def surrogate_check(made: DataFrame) -> DataFrame:
    """One row about replacements: `reused` surrogates that stand for several values, `changing` values with several surrogates, `leaked` surrogates that are
    a value of the corpus - each counted over distinct texts of one kind without regard to case."""
    p = made.select("kind", F.lower("value").alias("v"), F.lower("surrogate").alias("s")).distinct()
    many = lambda c: p.groupBy("kind", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    names = p.where("kind in ('name', 'email')")  # digits are permuted among all there are, so a number may come out that another one was
    leaked = names.select("kind", "s").join(names.select("kind", F.col("v").alias("s")), ["kind", "s"], "left_semi").distinct()
    found = {"reused": many("s"), "changing": many("v"), "leaked": leaked}
    rows = reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("what")) for n, d in found.items()))
    return rows.agg(*(F.count(F.when(F.col("what") == n, 1)).alias(n) for n in found))
