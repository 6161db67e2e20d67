"""Phenotypes as declarations: what tables they take, what features they build, how they predict.

A phenotype is a YAML file; its kind says how its text is read:

any_code, two_codes, union_codes - rules on codes, see operators.rules.
keywords - keyword bags over stems within a sentence (`keywords`), with `negators`, `history` words, `pairs` and single `words`; with `negation: windowed` any word of a keyword
    hits, and triggers (`triggers`, else the shipped ones) negate the words near them. `unstemmed` words are left as they are.
patterns - regular expressions (`patterns`, a list or name: pattern) on the lower-case note, or with `on: stems` on the stemmed whole note.
counts - how often each n-gram (`ngrams`) stands in the cleaned note; `cleaning: content` leaves content words (`stop`, `keep`) with their lemmas, else it is the standard cleaning.
scale - n-grams on text cleaned for scored scales (`ngrams`, `before`, `numbers`, `after`, `stop`, `chain`), a weighted sum clipped to `range`.

Events: `icd`, `cpt`, `med` are lists of patterns (a flag each), groups (name: patterns), or {ordered: {name: pattern}, names, else_text, total}: the first group
that matches, flagged for each of names (all groups if left out), the value itself where else_text is set and none matches, with the sum of the flags (or of those listed
under total_of) as `total`. `any: true` beside a list of patterns makes one flag of the role's name. `window` is an offset for both sides, one a role ({icd: 1y, med: -2y}; a
leading minus looks back only), or null: ever. With `undated` notes without a date meet all events. `demo: true` adds age and sex and drops notes without them.
`per_day` joins the notes of a day. `terms` are replacements after the standard cleaning.

Prediction: `weights` (feature: weight) and `bias`, or a saved `pipeline`, or a `booster` (JSON dump) with its `features` in order; strict `threshold`, unless `inclusive`. `tasks` (name:
weights, bias, threshold) gives a probability a task, `labels` likewise with strict thresholds, missing features as 0 and labels without a model left out.
`stated_grades` lets a grade that the note states override the outcome; of a class it is one from `poor` on.

Lists, weights and models are the phenotype's own matter; files of one's own are registered with Engine.register. Bundled ones without a model give features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.functions import stem, text
from phenoframe.operators import codes, match, rules, score, temporal
from phenoframe.sources.schema import load_yaml

RULES = ("any_code", "two_codes", "union_codes")
KINDS = (*RULES, "keywords", "patterns", "counts", "scale")


@dataclass
class Phenotype:
    name: str
    kind: str
    inputs: dict[str, dict[str, str]]
    params: dict[str, Any] = field(default_factory=dict)
    aliases: list[str] = field(default_factory=list)
    credits: str | None = None
    link: str | None = None

    @classmethod
    def load(cls, path: str | Path) -> Phenotype:
        d = load_yaml(Path(path))
        p = cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})
        if p.kind not in KINDS:
            raise ValueError(f"{p.name}: unknown kind {p.kind!r}")
        return p

    @property
    def keys(self) -> list[str]:
        return ["note_idx", *(c for c in ("id", "date") if c in self.inputs.get("note", {}))]


def spine_of(p: Phenotype, note: DataFrame) -> DataFrame:
    """The notes with note_idx, their number by a column `index` of theirs if they have one, else in the order of id, date and text; with per_day a row for each id and day."""
    if p.params.get("per_day"):
        indexed = "index" in note.columns
        note = temporal.texts_of_day(note.withColumn("_order", F.col("index" if indexed else "note")), ["id", "date"], "note", "_order")
        note = note.withColumnRenamed("_order", "index") if indexed else note.drop("_order")
    order = [c for c in ("index",) if c in note.columns] or [c for c in ("id", "date", "note") if c in note.columns]
    return temporal.numbered(note, *order)


def _tests(role: str, conf: Any, value: Column, one: bool) -> tuple[dict[str, Column], str | None, list[str]]:
    """The flags of a role's events, and the column that sums some of them."""
    if isinstance(conf, dict) and "ordered" in conf:
        group = codes.first_group(value, conf["ordered"], value if conf.get("else_text") else None)
        names = conf.get("names") or list(conf["ordered"])
        return codes.equal_tests(group, names), conf.get("total"), [codes.feature_name(n) for n in conf.get("total_of", names)]
    if one:
        return {role: codes.any_pattern(value, conf)}, None, []
    groups = conf if isinstance(conf, dict) else {codes.feature_name(x): [x.lower() if role == "med" else x] for x in conf}
    return codes.group_tests(value, groups), None, []


def code_block(p: Phenotype, role: str, spine: DataFrame, events: DataFrame) -> DataFrame:
    """One flag per configured pattern or group of a role, per note."""
    conf, window = p.params[role], p.params.get("window")
    one = isinstance(conf, dict) and conf.get("any")
    tests, total, parts = _tests(role, conf["patterns"] if one else conf, F.lower(role) if role == "med" else F.col(role), one)
    tests = {n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}
    window = window.get(role) if isinstance(window, dict) else window
    hit = reduce(lambda a, b: a | b, tests.values())
    if window is None:
        out = temporal.back_to_spine(spine, temporal.flags(events.where(hit), ["id"], tests), keys=["id"])
    elif str(window).startswith("-"):
        out = temporal.lookback_features(spine, events, str(window)[1:], tests, hit, undated=p.params.get("undated", False))
    else:
        out = temporal.windowed_features(spine, events, window, window, tests, hit, undated=p.params.get("undated", False))
    return codes.total(out, parts, total) if total else out


def _bags(p: Phenotype, sents: Column | str) -> dict[str, Column]:
    neg, hist = p.params.get("negators", []), p.params.get("history", [])
    out: dict[str, Column] = {}
    for k in p.params.get("keywords", []):
        name = codes.feature_name(k)
        if neg:
            out[f"{name}_"], out[f"{name}_neg_"] = match.bag_negated(sents, k, neg)
        else:
            out[f"{name}_"] = match.bag(sents, k)
        if hist:
            out[f"{name}_hist_"] = match.bag_with(sents, k, hist)
    for q in p.params.get("pairs", []):
        out[f"{q['name']}_"], out[f"{q['name']}_neg_"] = match.pair_negated(sents, q["any_of"], q["with"], neg)
    return out | {f"{codes.feature_name(w)}_": c for w, c in match.word_flags(sents, p.params.get("words", [])).items()}


def _window_flags(p: Phenotype, s: DataFrame) -> DataFrame:
    """Flags of keywords under windowed negation; the batch function gives an array in the order of the keywords."""
    found = match.windowed("s", p.params["keywords"], stem.STEMMERS[p.params.get("stemmer", "porter2")], p.params.get("triggers"), p.params.get("reach", match.WINDOW))
    s = s.select("note_idx", found.alias("w"))
    names = [codes.feature_name(k) for k in p.params["keywords"]]
    return s.select("note_idx", *(c for i, n in enumerate(names) for c in (F.col("w")[i]["asserted"].alias(f"{n}_"), F.col("w")[i]["negated"].alias(f"{n}_neg_"))))


def _content(p: Phenotype) -> Column:
    """Content words, their lemmas, and once more without stop words and short ones."""
    stop, keep = p.params.get("stop", []), p.params.get("keep", [])
    words = stem.stem_words(F.split(text.content_words("note", stop, keep), " "), "noun")
    return F.array_join(text.content_filter(words, stop, keep), " ")


def text_block(p: Phenotype, notes: DataFrame) -> DataFrame:
    """note_idx and the features of the note's text; stems are computed once for all keywords."""
    stemmer = p.params.get("stemmer", "porter2")
    cleaned = text.unify_terms("note", *(tuple(x) for x in p.params.get("terms", [])))
    if p.kind == "patterns":
        named = p.params["patterns"] if isinstance(p.params["patterns"], dict) else {codes.feature_name(x): x for x in p.params["patterns"]}
        on = F.array_join(stem.stem_words(text.tokens(cleaned), stemmer), " ") if p.params.get("on") == "stems" else F.lower("note")
        s = notes.select("note_idx", on.alias("t"))
        return s.select("note_idx", *(text.matches("t", x).alias(f"{n}_") for n, x in named.items()))
    if p.kind == "counts":
        s = notes.select("note_idx", (_content(p) if p.params.get("cleaning") == "content" else cleaned).alias("t"))
        return s.select("note_idx", *(text.ngram_count("t", g).alias(codes.feature_name(g) + "_") for g in p.params["ngrams"]))
    if p.kind == "scale":
        pairs = {k: [tuple(x) for x in p.params.get(k, [])] for k in ("before", "numbers", "after", "remove")}
        chain = text.clean_graded if p.params.get("chain") == "numbers_first" else text.clean_scored
        t = chain("note", **pairs, stop=p.params.get("stop", []))
        s = notes.select("note_idx", F.trim(text.dedup_words(F.array_join(stem.stem_words(F.split(t, " "), "porter"), " "))).alias("t"))
        return s.select("note_idx", *(text.ngram_present("t", g).alias(codes.feature_name(g) + "_") for g in p.params["ngrams"]))
    s = notes.select("note_idx", stem.stem_nested(text.sentence_tokens(cleaned), stemmer, p.params.get("unstemmed", [])).alias("s"))
    return _window_flags(p, s) if p.params.get("negation") == "windowed" else s.select("note_idx", *(c.alias(n) for n, c in _bags(p, "s").items()))


def features(p: Phenotype, data: dict[str, DataFrame]) -> DataFrame:
    """One row per note: note_idx, id, date and all features; 0 where an event block has nothing."""
    notes = spine_of(p, data["note"])
    spine = notes.select(*p.keys)
    out = spine
    for role in ("icd", "cpt", "med"):
        if role in p.params and role in data:
            block = code_block(p, role, spine, data[role])
            out = out.join(block.drop(*(k for k in p.keys if k != "note_idx")), "note_idx", "left")
    out = out.join(text_block(p, notes), "note_idx", "left")
    out = out.na.fill(0, [c for c in out.columns if c not in p.keys])
    return temporal.demographics(out, data["demo"].select("id", "date_of_birth", "sex")).na.drop("any") if p.params.get("demo") else out


def _probability(p: Phenotype, f: DataFrame, load: Callable[[str], Any]) -> DataFrame:
    """Features with _p: the weighted sum of a scale, else a probability."""
    if p.params.get("booster"):
        names = p.params["features"]
        f = score.aligned_features(f, p.keys, names)
        return score.boosted(f, score.Booster.load(p.params["booster"], names, p.params.get("base", 0.0)), "_p")
    if p.params.get("pipeline"):
        scored = load(p.params["pipeline"]).transform(f)
        return scored.withColumn("_p", F.col("prediction") if p.kind == "scale" else vector_to_array("probability")[1])
    if "weights" not in p.params:
        raise ValueError(f"{p.name} has no model: give it weights, a pipeline or a booster; its features can be had")
    made = score.linear if p.kind == "scale" else score.logistic
    return f.withColumn("_p", made(p.params["weights"], p.params.get("bias", 0.0)))


def predict(p: Phenotype, data: dict[str, DataFrame], load: Callable[[str], Any] = PipelineModel.load) -> tuple[DataFrame | None, DataFrame]:
    """(features or None, predictions)."""
    if p.kind in RULES:
        first = data[next(iter(p.inputs))]
        if p.kind == "any_code":
            out = rules.any_code(first, "icd", p.params["icd"])
        elif p.kind == "two_codes":
            out = rules.two_codes(first, "icd", p.params["icd"], over=p.params.get("over_days", 7), most=p.params.get("most_days", 365), tie=("icd",))
        else:
            out = rules.union_codes([(data[r], r, p.params[r], r) for r in p.inputs])
        order = [c for c in ("id", "date", "code", "icd", "code_type") if c in out.columns]
        out = temporal.numbered(out, *order)
        return out if p.kind == "two_codes" else None, out  # pairs of codes are their own features
    f = features(p, data)
    if p.params.get("tasks"):
        probs = {t: score.logistic(m["weights"], m.get("bias", 0.0)) for t, m in p.params["tasks"].items()}
        out = score.multi(f, probs, {t: m.get("threshold", 0.5) for t, m in p.params["tasks"].items()}, p.params.get("inclusive", True))
        return f, out.select(*p.keys, *(c for t in probs for c in (f"prob_{t}", f"pred_{t}")))
    if p.params.get("labels"):
        return f, score.multi_label(f, p.keys, p.params["labels"])
    scored = _probability(p, f, load)
    grade = None
    if p.params.get("stated_grades"):
        notes = spine_of(p, data["note"]).select("note_idx", score.stated_grade("note").alias("_g"))
        scored, grade = scored.join(notes, "note_idx", "left"), F.col("_g")
    if p.kind == "scale":
        low, high = p.params.get("range", [0, 42])
        name = p.params.get("score", "score")
        out = score.clipped(scored, "_p", float(low), float(high), name)
        out = out if grade is None else out.withColumn(name, F.coalesce(grade.cast("double"), name))
        return f, out.select(*p.keys, name)
    if grade is not None:
        return f, score.overridden(scored, grade, "_p", p.params.get("poor", 3), p.params.get("threshold", 0.5)).select(*p.keys, "prob_poor", "prediction")
    return f, score.binary(scored, "_p", p.params.get("threshold", 0.5), p.params.get("inclusive", False)).select(*p.keys, "prob_NO", "prob_YES", "prediction")
