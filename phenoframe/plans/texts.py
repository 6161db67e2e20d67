"""Queries on note text: cleaning, patterns, keyword matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.functions import stem, text
from phenoframe.operators import codes, match, score, temporal
from phenoframe.plans.base import Book, notes, sql
from phenoframe.session import spread, table

query = Book()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "notes").where("note is not null").select("note_id", "note"))


_STD = r"lower(trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9 \n.]', '', 'g'), '\s+', ' ', 'g')))"
_NOTES = "(select note_id, note from notes where note is not null)"


def std(x: str = "note") -> str:
    return _STD.replace("{x}", x)


@query(f"select note_id, {std()} as cleaned from {_NOTES}")
def clean_standard(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.clean_standard("note").alias("cleaned"))


@query(rf"""
select note_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(note, '\bw/\b', ' with ', 'g'), '\bw/o\b', ' without ', 'g'),
  '[:;()\[\]\\/]', ' ', 'g'), '\.', '. ', 'g'), '[^A-Za-z0-9 \n.]', '', 'g'), '\s+', ' ', 'g')) as cleaned from {_NOTES}""")
def clean_spaced(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.clean_spaced("note").alias("cleaned"))


@query(f"select note_id, regexp_replace({std()}, 'staring spells?|jerking', 'seizure', 'g') as cleaned from {_NOTES}")
def term_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.unify_terms("note", ("staring spells?|jerking", "seizure")).alias("cleaned"))


STOP = ["the", "and", "was", "were", "for", "with", "from", "that", "this", "are"]


@query(rf"""
select note_id, case when x = '' then ' ' else x end as words from (select note_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(note), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'), '[0-9]', '', 'g'), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g')), ' '),
  lambda w: not list_contains(['{"','".join(STOP)}'], w) and (length(w) >= 3 or w = 'lp') and w <> ''), ' ') as x from {_NOTES})""")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.content_words("note", STOP, ["lp"]).alias("words"))


PATTERNS = {"mri": r"\bmri\b", "memory": r"memory\s+(lapses|loss)", "dose": r"\d+(\.\d+)? mg"}


@query("select note_id, " + ", ".join(f"regexp_matches(lower(note), '{p}')::int as {n}" for n, p in PATTERNS.items()) + f" from {_NOTES}")
def regex_flags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", *(text.matches(F.lower("note"), p).alias(n) for n, p in PATTERNS.items()))


NGRAMS = ["neck stiffness", "no", "mg", "head ct"]


def _padded(g: str) -> str:
    # RE2 has no look-around: blanks are doubled, so that neighbours share none
    return rf"len(regexp_extract_all(' ' || replace({std()}, ' ', '  ') || ' ', '(^|[^a-z]){g.replace(' ', '  ')}[^a-z]'))"


@query("select note_id, " + ", ".join(f"{_padded(g)}::int as {codes.feature_name(g)}" for g in NGRAMS) + f" from {_NOTES}")
def ngram_count(spark: SparkSession, d: str) -> DataFrame:
    c = _texts(spark, d).select("note_id", text.clean_standard("note").alias("c"))
    return c.select("note_id", *(text.ngram_count("c", g).alias(codes.feature_name(g)) for g in NGRAMS))


@query("select note_id, " + ", ".join(f"({_padded(g)} > 0)::int as {codes.feature_name(g)}" for g in NGRAMS) + f" from {_NOTES}")
def ngram_presence(spark: SparkSession, d: str) -> DataFrame:
    c = _texts(spark, d).select("note_id", text.clean_standard("note").alias("c"))
    return c.select("note_id", *(text.ngram_present("c", g).alias(codes.feature_name(g)) for g in NGRAMS))


@query(rf"""
select note_id, array_to_string(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), ' ') as deduped from (
  select note_id, string_split(trim(regexp_replace(regexp_replace(lower(note), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), ' ') as w from {_NOTES})""")
def dedup_words(spark: SparkSession, d: str) -> DataFrame:
    c = F.trim(text.steps(F.lower("note"), ("[^a-z0-9 ]", " "), (r"\s+", " ")))
    return _texts(spark, d).select("note_id", text.dedup_words(c).alias("deduped"))


PAIRS = [("right more than left", "right"), ("left more than right", "left"), ("w/", "with"), ("p.r.n.", "as needed"), ("  ", " ")]


def _chain(x: str) -> str:
    for a, b in PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"select note_id, {_chain('lower(note)')} as replaced from {_NOTES}")
def literal_replace_chain(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.literals(F.lower("note"), PAIRS).alias("replaced"))


@query(rf"select note_id, list_extract(regexp_extract_all(note, '(\d+) spells', 1), -1) as spells, list_extract(regexp_extract_all(lower(note), 'since (\w+)', 1), -1) as since from {_NOTES}")
def last_match_extract(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.last_match("note", r"(\d+) spells").alias("spells"), text.last_match(F.lower("note"), r"since (\w+)").alias("since"))


#: What is added to each note in turn, so that every rule of stated grades is met.
STATED = [
    "", "Modified Rankin Scale is 3.", "Premorbid rankin 1, now mRS: 2", "mrs of 4, later Rankin scale of 2", "The patient has died at home.", "Her mother passed away, rankin - 1",
    "[x] 5 - The patient has severe disability", "Comprehensive Stroke Center: [ ] 4 - the patient has moderately severe disability", "Comprehensive stroke center [x]2-the patient has slight disability. mrs 5", "Time of death 10:40. mRS 0", "rankin about 3", "mRS 7",
]
_QUOTED = "', '".join(STATED)
_WITH = f"(select note_id, note || ' ' || list_extract(['{_QUOTED}'], (note_id % {len(STATED)} + 1)::int) as note from notes where note is not null)"


def _stated(spark: SparkSession, d: str) -> DataFrame:
    more = F.element_at(F.array(*(F.lit(x) for x in STATED)), (F.col("note_id") % len(STATED) + 1).cast("int"))
    return _texts(spark, d).select("note_id", F.concat("note", F.lit(" "), more).alias("note"))


_GRADE = f"""case when {" or ".join(f"contains(t, '{p}')" for p in score.DEATH)} then 6
  when contains(t, '{score.RUBRIC_NEEDS}') and regexp_matches(t, '{"|".join(f"{g} ?- ?{x}" for g, x in score.RUBRIC.items())}') then
    case {" ".join(f"when regexp_matches(t, '{g} ?- ?{x}') then {g}" for g, x in score.RUBRIC.items())} end
  else list_extract(regexp_extract_all(replace(replace(t, 'mrs', 'rankin'), 'premorbid rankin', ''), 'rankin( scale)?( is)?( of)? *[:-]? *([0-5])\\b', 4), -1)::int end"""


@query(f"select note_id, {_GRADE} as grade from (select note_id, lower(note) as t from {_WITH})")
def phrase_override(spark: SparkSession, d: str) -> DataFrame:
    """The grade that each note states by the shipped phrases, rubric and mention."""
    return _stated(spark, d).select("note_id", score.stated_grade("note").alias("grade"))


@query(f"""
select note_id, case when grade is null then round(p, 6) when grade >= 3 then 1.0 else 0.0 end as prob_poor, case when grade is null then (p >= 0.5)::int else (grade >= 3)::int end as prediction
from (select note_id, (note_id % 1000) / 1000.0::double as p, {_GRADE} as grade from (select note_id, lower(note) as t from {_WITH}))""")
def grade_overrides_model(spark: SparkSession, d: str) -> DataFrame:
    """A probability that a stated grade overrides."""
    s = _stated(spark, d).withColumn("p", F.round(F.col("note_id") % 1000 / 1000.0, 6))
    return score.overridden(s, score.stated_grade("note"), "p").select("note_id", "prob_poor", "prediction")


@query(sql("select id, date, min(idx) as idx, string_agg(note, ' ' order by idx) as note from n where note is not null group by 1, 2"), dates=("date",))
def concat_same_day(spark: SparkSession, d: str) -> DataFrame:
    return temporal.texts_of_day(notes(spark, d).where("note is not null"), ["id", "date"], "note", "idx")


def words_of(x: str) -> str:
    """SQL for the words of each sentence of a text, in list functions: the rules of functions.text once more."""
    ss = rf"list_transform(string_split_regex(regexp_replace({std(x)}, '\b(dr|mr|mrs|ms|prof|vs|etc|e\.g|i\.e|approx|no|[a-z])\. ', '\1.' || chr(1), 'g'), '\.\s+'), lambda s: replace(s, chr(1), ' '))"
    bare = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\.+(\s|$)', ' ', 'g'), '\bcannot\b', 'can not', 'g'), '\bgonna\b', 'gon na', 'g'), '\bgotta\b', 'got ta', 'g'), '\s+', ' ', 'g')"
    return f"list_transform({ss}, lambda s: list_filter(string_split(trim({bare}), ' '), lambda w: w <> ''))"


_SENT = f"k as (select note_id, {words_of('note')} as ss from {_NOTES})"
NEG = ["no", "not", "denies", "without", "negative", "absent"]
_NEGL = "['" + "','".join(NEG) + "']"


def _has(words: str) -> str:
    return " and ".join(f"list_contains(s, '{w}')" for w in words.split())


def _any(test: str) -> str:
    return f"(len(list_filter(ss, lambda s: {test})) > 0)::int"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("note_id", text.sentence_tokens(text.clean_standard("note")).alias("ss"))


BAGS = {"neck_stiffness": "stiffness neck", "double_vision": "vision double", "loss_smell": "loss of smell"}


@query(f"with {_SENT} select note_id, " + ", ".join(f"{_any(_has(b))} as {n}" for n, b in BAGS.items()) + " from k")
def bag_match(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("note_id", *(match.bag("ss", b).alias(n) for n, b in BAGS.items()))


@query(
    f"with {_SENT} select note_id, "
    + ", ".join(f"{_any(f'{_has(b)} and not list_has_any(s, {_NEGL})')} as {n}, {_any(f'{_has(b)} and list_has_any(s, {_NEGL})')} as {n}_neg" for n, b in BAGS.items())
    + " from k"
)
def bag_negation(spark: SparkSession, d: str) -> DataFrame:
    cols = []
    for n, b in BAGS.items():
        yes, no = match.bag_negated("ss", b, NEG)
        cols += [yes.alias(n), no.alias(f"{n}_neg")]
    return _sentences(spark, d).select("note_id", *cols)


HIST = ["history", "former", "previously"]


@query(f"with {_SENT} select note_id, " + ", ".join(f"{_any(_has(b) + ' and list_has_any(s, [' + repr(HIST)[1:-1] + '])')} as {n}_hist" for n, b in BAGS.items()) + " from k")
def bag_history(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("note_id", *(match.bag_with("ss", b, HIST).alias(f"{n}_hist") for n, b in BAGS.items()))


@query(f"with {_SENT} select note_id, {_any(f'''list_has_any(s, ['started','stopped']) and list_contains(s, 'after') and not list_has_any(s, {_NEGL})''')} as hit, {_any(f'''list_has_any(s, ['started','stopped']) and list_contains(s, 'after') and list_has_any(s, {_NEGL})''')} as hit_neg from k")
def strike_rule(spark: SparkSession, d: str) -> DataFrame:
    yes, no = match.pair_negated("ss", ["started", "stopped"], "after", NEG)
    return _sentences(spark, d).select("note_id", yes.alias("hit"), no.alias("hit_neg"))


@query(f"with {_SENT} select note_id, {_any(_has('seizure diary'))} as pro, {_any(_has('is absent'))} as neg, list_contains(flatten(ss), 'velumodor')::int as velumodor, list_contains(flatten(ss), 'haloplemate')::int as haloplemate from k")
def pro_neg_bags(spark: SparkSession, d: str) -> DataFrame:
    words = match.word_flags("ss", ["velumodor", "haloplemate"])
    return _sentences(spark, d).select("note_id", match.bag("ss", "seizure diary").alias("pro"), match.bag("ss", "is absent").alias("neg"), *(c.alias(w) for w, c in words.items()))


# Fixed values for the SQL: the forms of words that have a stem in the published English algorithm, instead of the algorithm.
FORMS = {
    "fall": "fall falls falling", "headach": "headache headaches", "neck": "neck necks", "stiff": "stiff stiffness", "deni": "deny denies denied", "absenc": "absence absences", "negat": "negative negatives negated negation", "rule": "rule rules ruled ruling", "unlik": "unlike unlikely", "unremark": "unremarkable",
    "exclud": "exclude excludes excluded excluding", "onli": "only", "increas": "increase increases increased increasing", "dizzi": "dizzy dizziness", "swallow": "swallow swallows swallowing swallowed", "choke": "choke chokes choked choking", "liquid": "liquid liquids", "seizur": "seizure seizures", "diari": "diary diaries", "tremor": "tremor tremors",
}
_LISTED = "', '"
_FORM = " ".join(f"when w in ('{_LISTED.join(forms.split())}') then '{stem_}'" for stem_, forms in FORMS.items())
# negation_window (what is a trigger before is none after): words of sentences by place, triggers of one to three words, stretches they negate, those lifted, and keywords' hits
_TRIGGERS = [(x, "before") for x in ("no", "deni", "absenc", "not", "negat", "without", "rule out", "unlik", "free of", "never", "unremark for")] + [("exclud", "after"), ("absent", "after"), ("not onli", "pseudo"), ("no increas", "pseudo")]


@query(f"""
with {_SENT},
u as (select note_id, generate_subscripts(ss, 1) as s, unnest(ss) as ws from k),
w as (select note_id, s, len(ws) as n, generate_subscripts(ws, 1) - 1 as i, unnest(ws) as w from u),
f as (select note_id, s, n, i, case {_FORM} else w end as f from w),
p as (select note_id, s, n, i, 1 as size, f as phrase from f
  union all select a.note_id, a.s, a.n, a.i, 2, a.f || ' ' || b.f from f a join f b on a.note_id = b.note_id and a.s = b.s and b.i = a.i + 1 where a.i + 2 < a.n),
t as (select * from p join (values {", ".join(str(x) for x in _TRIGGERS)}) t(phrase, kind) using (phrase)),
r as (select *, case kind when 'before' then i + size - 1 else greatest(0, i - 5) end as lo, case kind when 'before' then least(i + size + 4, n) else i end as hi from t where kind <> 'pseudo'),
l as (select r.* from r where not exists (select 1 from t where t.kind = 'pseudo' and t.note_id = r.note_id and t.s = r.s and (t.i > r.i or t.i = r.i and t.size > r.size) and r.lo <= t.i and t.i + t.size - 1 <= r.hi)),
h as (select f.note_id, f.s, q.keyword, exists (select 1 from l where l.note_id = f.note_id and l.s = f.s and f.i between lo and hi) as denied
  from f join (values ('fall', 'fall'), ('headach', 'headach'), ('neck stiff', 'neck'), ('neck stiff', 'stiff')) q(keyword, word) on f.f = q.word),
g as (select note_id, keyword, s, bool_or(denied) as denied from h group by 1, 2, 3)
select k.note_id, q.keyword, coalesce(max((not denied)::int), 0)::int as asserted, coalesce(max(denied::int), 0)::int as negated
from k cross join (values ('fall'), ('headach'), ('neck stiff')) q(keyword) left join g on g.note_id = k.note_id and g.keyword = q.keyword group by 1, 2""")
def negation_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows (note_id, keyword, asserted, negated) under the windowed scope over stems."""
    s = _sentences(spark, d).withColumn("ss", stem.stem_nested("ss"))
    w = match.windowed("ss", ["fall", "headach", "neck stiff"], stem.porter2)
    return s.select("note_id", F.explode(w).alias("x")).select("note_id", "x.*")


_STEMMED = f"{_SENT}, z as (select note_id, list_transform(ss, lambda s: list_transform(s, lambda w: case {_FORM} else w end)) as ss from k)"
STEM_BAGS = {"stiff": "stiff neck", "dizzi": "dizzi", "swallow": "choke liquid"}
_STEM_NEG = "['no', 'not', 'deni', 'without']"


@query(f"with {_STEMMED} select note_id, " + ", ".join(f"{_any(f'{_has(b)} and not list_has_any(s, {_STEM_NEG})')} as {n}, {_any(f'{_has(b)} and list_has_any(s, {_STEM_NEG})')} as {n}_neg" for n, b in STEM_BAGS.items()) + " from z")
def stem_bags(spark: SparkSession, d: str) -> DataFrame:
    """Bags over stems with negation, one stemming pass for all keywords."""
    s = _sentences(spark, d).withColumn("ss", stem.stem_nested("ss"))
    cols = []
    for n, b in STEM_BAGS.items():
        yes, no = match.bag_negated("ss", b, ["no", "not", "deni", "without"])
        cols += [yes.alias(n), no.alias(f"{n}_neg")]
    return s.select("note_id", *cols)


_TOKENS = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({std()}, '\.+(\s|$)', ' ', 'g'), '\bcannot\b', 'can not', 'g'), '\bgonna\b', 'gon na', 'g'), '\bgotta\b', 'got ta', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""
select note_id, coalesce(regexp_matches(t, '\\bseizur diari\\b'), false)::int as diary, len(list_filter(string_split(replace(t, '.', ' '), ' '), lambda w: w in ('fall', 'tremor')))::int as n_falls, 0 as n_invalid
from (select note_id, array_to_string(list_transform({_TOKENS}, lambda w: case {_FORM} else w end), ' ') as t from {_NOTES})""")
def stem_regex(spark: SparkSession, d: str) -> DataFrame:
    """Patterns on the stemmed whole text: presence and counts."""
    s = _texts(spark, d).select("note_id", F.array_join(stem.stem_words(text.tokens(text.clean_standard("note")), "porter2"), " ").alias("t"))
    return s.select("note_id", text.matches("t", r"\bseizur\w* diari\b").alias("diary"), text.pattern_count("t", "fall|tremor").alias("n_falls"), text.pattern_count("t", "(broken").alias("n_invalid"))


BEFORE, NUMBERS, AFTER, REMOVE = [("w/", "with "), ("&", " and ")], [(r"\b(\d)/5\b", " power grade "), (r"score was \d+/100", "score given")], [("right more than left", "right")], [("scale", " "), ("score", " ")]
WITHOUT = ["the", "and", "of", "a", "was", "with"]
_SCORED = {"before": BEFORE, "numbers": NUMBERS, "after": AFTER, "remove": REMOVE, "stop": WITHOUT}


def _sql_chain(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_numbers(x: str, flags: str) -> str:
    for p, r in NUMBERS:
        x = f"regexp_replace({x}, '{p}', '{r}', '{flags}')"
    return x


def _sql_once(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w, i: i = 1 or w <> string_split({x}, ' ')[i - 1]), ' ')"


def _sql_letters(x: str) -> str:
    for p, r in ((r"\d+", ""), ("/l", " "), (r"[^A-Za-z0-9 \n.]", " "), (r"\.", " "), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def _sql_scored(first: str, later: list[tuple[str, str]]) -> str:
    stop = "', '".join(WITHOUT)
    return f"""
with a as (select note_id, {first} as x from {_NOTES}), b as (select note_id, {_sql_once("x")} as x from a), c as (select note_id, {_sql_chain("x", later)} as x from b),
e as (select note_id, array_to_string(list_filter(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '), lambda w: w not in ('{stop}') and w <> ''), ' ') as x from c)
select note_id, {_sql_once("x")} as t from e"""


@query(_sql_scored(_sql_letters(_sql_numbers(_sql_chain("lower(note)", BEFORE), "gi")), AFTER + REMOVE))
def scale_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning for scored scales up to the stop words."""
    return _texts(spark, d).select("note_id", text.clean_scored("note", **_SCORED).alias("t"))


@query(_sql_scored(_sql_letters(_sql_numbers("regexp_replace(replace(" + _sql_chain("regexp_replace(lower(note), '\\s+', ' ', 'g')", BEFORE) + ", ',', ' '), '\\s+', ' ', 'g')", "g")), AFTER + REMOVE))
def grade_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """The variant with another order of its steps."""
    return _texts(spark, d).select("note_id", text.clean_graded("note", **_SCORED).alias("t"))


@query()
def scored_scale_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning for scored scales with Porter stems; numbers become phrases before digits go. Stems of every word: no SQL, but tests of the published examples."""
    s = _texts(spark, d).select("note_id", text.clean_scored("note", **_SCORED).alias("t"))
    return s.select("note_id", F.trim(text.dedup_words(F.array_join(stem.stem_words(F.split("t", " "), "porter"), " "))).alias("t"))
