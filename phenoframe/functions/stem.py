"""Stemmers of the published Porter algorithms and the Arrow functions that run them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phenoframe.functions.text import col

_V = "aeiouy"
# Fixed values of the published English (Porter2) algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(rf"[{_V}][^{_V}]", w))


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    """The English (Porter2, Snowball) stem of a word, in lower case."""
    w = word.lower()
    if w in _SPECIAL:
        return _SPECIAL[w]
    if len(w) <= 2 or w in _KEEP:
        return w
    w = w.lstrip("'")
    w = re.sub(rf"(?:^|(?<=[{_V}]))y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(rf"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # step 1b
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and re.search(f"[{_V}]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # step 2
    end = next((e for e in sorted((*_STEP2, "ogi", "li"), key=len, reverse=True) if w.endswith(e)), None)
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in _LI else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    # step 3
    end = next((e for e in sorted((*_STEP3, "ative"), key=len, reverse=True) if w.endswith(e)), None)
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]
    # step 4
    end = next((e for e in sorted((*_STEP4, "ion"), key=len, reverse=True) if w.endswith(e)), None)
    if end and len(w) - len(end) >= r2:
        if end != "ion" or w[-4:-3] in ("s", "t"):
            w = w[: -len(end)]
    # step 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def _measure(w: str) -> int:
    form = "".join("c" if _is_c(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", form))


def _is_c(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _is_c(w, i - 1))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _is_c(w, len(w) - 1) and not _is_c(w, len(w) - 2) and _is_c(w, len(w) - 3) and w[-1] not in "wxy"


# Fixed values of the published Porter algorithm.
_P2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_P3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_P4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The Porter stem of a word, in lower case."""
    w = word.lower()
    if len(w) <= 2:
        return w
    has_vowel = lambda s: any(not _is_c(s, i) for i in range(len(s)))
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e)), None)
        if end and has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _is_c(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_P2, _P3):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next((e for e in sorted(_P4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# English nouns whose singular no rule gives, by kind.
#: Words that end like a plural and are none.
_ALIKE = frozenset(
    "diabetes series species pancreas atlas bias gas canvas alias rabies scabies caries facies herpes measles mumps shingles lens biceps triceps quadriceps forceps pus sepsis asbestos ascites pertussis tetanus lues "
    "chaos kudos aids news physics mathematics genetics pediatrics obstetrics orthopedics statistics ethics hysterics gallows cosmos pathos stapes always perhaps besides across towards its his this hers ours yours theirs".split()
)
_IRREGULAR = {
    "feet": "foot", "teeth": "tooth", "children": "child", "mice": "mouse", "lice": "louse", "geese": "goose", "oxen": "ox", "people": "people", "men": "man", "women": "woman",
    "axes": "axis", "emphases": "emphasis", "atlases": "atlas", "biases": "bias", "gases": "gas", "canvases": "canvas", "aliases": "alias", "lenses": "lens", "testes": "testis", "theses": "thesis", "crises": "crisis", "bases": "base", "indices": "index", "matrices": "matrix", "vertices": "vertex", "vortices": "vortex", "appendices": "appendix", "cervices": "cervix", "cortices": "cortex", "apices": "apex", "calices": "calix", "helices": "helix",
    "bacteria": "bacterium", "criteria": "criterion", "phenomena": "phenomenon", "ganglia": "ganglion", "septa": "septum", "atria": "atrium", "ova": "ovum", "sera": "serum", "strata": "stratum", "media": "medium", "crania": "cranium", "ischia": "ischium",
    "vertebrae": "vertebra", "bursae": "bursa", "papillae": "papilla", "scapulae": "scapula", "fibulae": "fibula", "tibiae": "tibia", "conchae": "concha", "larvae": "larva", "fistulae": "fistula", "petechiae": "petechia", "aortae": "aorta", "venae": "vena",
    "nuclei": "nucleus", "fungi": "fungus", "bronchi": "bronchus", "stimuli": "stimulus", "emboli": "embolus", "thrombi": "thrombus", "foci": "focus", "loci": "locus", "bacilli": "bacillus", "calculi": "calculus", "gyri": "gyrus", "sulci": "sulcus", "thalami": "thalamus", "rami": "ramus", "alumni": "alumnus", "radii": "radius", "humeri": "humerus", "menisci": "meniscus", "villi": "villus",
    "knives": "knife", "lives": "life", "wives": "wife", "midwives": "midwife", "housewives": "housewife", "halves": "half", "calves": "calf", "leaves": "leaf", "loaves": "loaf", "wolves": "wolf", "shelves": "shelf", "selves": "self", "thieves": "thief", "scarves": "scarf", "elves": "elf",
    "movies": "movie", "cookies": "cookie", "calories": "calorie", "ties": "tie", "pies": "pie", "dies": "die", "lies": "lie", "prairies": "prairie", "brownies": "brownie", "genies": "genie", "selfies": "selfie", "quizzes": "quiz", "buses": "bus", "biopsies": "biopsy",
}
#: Nouns in -men that are no plurals; compounds of man are.
_MEN = frozenset("abdomen specimen regimen semen acumen lumen foramen stamen hymen omen albumen bitumen rumen cyclamen examen dolmen numen putamen cerumen tegmen".split())
_ACHES = frozenset("ache headache backache toothache earache stomachache heartache bellyache mustache moustache cache niche avalanche cliche psyche quiche creche pastiche".split())
_OES = frozenset("toe shoe hoe foe woe canoe oboe tiptoe horseshoe doe roe floe".split())
_USES = frozenset("use cause house spouse excuse fuse abuse pause clause blouse menopause recluse ruse misuse reuse overuse grouse warehouse louse mouse muse hypotenuse".split())
_OSES = frozenset("dose nose rose hose pose purpose overdose pantyhose glucose lactose sucrose fructose maltose cellulose lose close prose".split())


def noun(word: str) -> str:
    """The singular of an English noun in lower case by rule and list, in place of a dictionary lemmatizer; what is no plural stays as it is."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if word.endswith("men") and len(word) > 4:
        return word if word in _MEN else word[:-3] + "man"
    if not word.endswith("s") or len(word) <= 3 or word in _ALIKE or word.endswith(("ss", "us", "is")):
        return word
    one, es = word[:-1], word[:-2]
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "shes", "zzes", "tzes")):
        return es
    if word.endswith("ches"):
        return one if one in _ACHES else es
    if word.endswith("oes"):
        return one if one in _OES else es
    if word.endswith("uses"):
        return one if one in _USES or any(one.endswith(u) for u in ("house", "cause", "mouse", "clause")) else es
    if word.endswith("oses"):
        return one if one in _OSES else es + "is"
    return es + "is" if word.endswith(("yses", "stases", "theses", "reses", "neses", "teses")) else one


STEMMERS = {"porter2": porter2, "porter": porter, "noun": noun}


def stem_nested(c: Column | str, stemmer: str = "porter2", keep: Iterable[str] = ()) -> Column:
    """array<array<string>> of words to their stems, in Arrow batches; each worker remembers the words it met. Words in keep stay as they are."""
    as_is, plain = frozenset(keep), STEMMERS[stemmer]
    f = (lambda w: w if w in as_is else plain(w)) if as_is else plain

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else [[f(w) for w in y] for y in x] for x in s], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<string>>")(col(c))


def stem_words(c: Column | str, stemmer: str = "porter2") -> Column:
    """array<string> of words to their stems."""
    return F.flatten(stem_nested(F.array(col(c)), stemmer))
