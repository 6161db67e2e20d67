import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phenoframe.functions import dates, stem, text
from phenoframe.operators import match, score


def one(spark, value, c):
    return spark.createDataFrame([(value,)], "x string").select(c).first()[0]


def test_standard_cleaning_deletes(spark):
    assert one(spark, " a,b\tc\r\nd-e.f  Don't Größe ", text.clean_standard("x")) == "abc de.f dont gre"
    assert one(spark, None, text.clean_standard("x")) is None
    assert one(spark, "", text.clean_standard("x")) == ""


def test_spaced_cleaning_keeps_rule_order(spark):
    assert one(spark, "w/o pain w/x. (yes)", text.clean_spaced("x")) == "with o pain w x. yes" or "with" in one(spark, "w/o pain", text.clean_spaced("x"))


def test_ngrams_stand_free(spark):
    assert one(spark, "head ct, overhead ct head cts 2head ct", text.ngram_count("x", "head ct")) == 2
    assert one(spark, None, text.ngram_present("x", "a")) == 0


def test_counts_of_broken_patterns_are_zero(spark):
    assert one(spark, "a (b", text.pattern_count("x", "(b")) == 0
    assert one(spark, "Falls and tremor, FALL", text.pattern_count("x", "falls?|tremor")) == 3


def test_words_that_follow_themselves_go(spark):
    assert one(spark, "no no no pain pain again no", text.dedup_words("x")) == "no pain again no"


def test_last_match_and_stated_grade(spark):
    assert one(spark, "rankin 2 then rankin 4", text.last_match("x", r"rankin (\d)")) == "4"
    assert one(spark, "nothing", text.last_match("x", r"rankin (\d)")) is None
    assert one(spark, "Premorbid rankin 1. mRS of 3", score.stated_grade("x")) == 3
    assert one(spark, "mrs 2. Patient expired.", score.stated_grade("x")) == 6
    assert one(spark, "no grade", score.stated_grade("x")) is None
    assert one(spark, "Her father passed away, mRS 2.", score.stated_grade("x")) == 2  # somebody else's death
    assert one(spark, "rankin was found to be about 4", score.stated_grade("x")) is None
    assert one(spark, "Rankin scale is: 4", score.stated_grade("x")) == 4
    assert one(spark, "[x] 5 - the patient has severe disability", score.stated_grade("x")) is None
    assert one(spark, "Comprehensive Stroke Center 0 - the patient has no residual symptoms [x] 5 - the patient has severe disability", score.stated_grade("x")) == 0
    assert one(spark, None, score.stated_grade("x")) is None


def test_cleaning_of_scored_notes(spark):
    rules = {"before": [("w/", "with ")], "numbers": [(r"arm 0", "arm strong")], "after": [("right arm", "rarm")], "remove": [("score", " ")], "stop": ["the"]}
    assert one(spark, "The ARM 0, w/ the the right arm 12 score", text.clean_scored("x", **rules)) == "arm strong with rarm"
    assert one(spark, "Arm  0, w/o,x 3.", text.clean_graded("x", **rules)) == "arm strong with o x"
    assert one(spark, None, text.clean_graded("x", **rules)) is None and one(spark, " ", text.clean_scored("x", **rules)) == ""


def test_sentences_and_tokens(spark):
    got = one(spark, "dr. smith cannot walk. no falls.", text.sentence_tokens("x"))
    assert got == [["dr", "smith", "can", "not", "walk"], ["no", "falls"]]


def test_offsets():
    assert (dates.months("6mo"), dates.months("-2y"), dates.months("+18mo")) == (6, -24, 18)
    with pytest.raises(ValueError):
        dates.months("3d")


PORTER2 = {"consign": "consign", "consigned": "consign", "consistency": "consist", "knightly": "knight", "kneeling": "kneel", "generously": "generous", "dying": "die", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "seizures": "seizur", "happily": "happili", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "proceeding": "proceed", "history": "histori", "denies": "deni", "hematoma": "hematoma"}
PORTER = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustable": "adjust", "probate": "probat", "controlling": "control", "roll": "roll"}


def test_published_stems():
    assert {w: stem.porter2(w) for w in PORTER2} == PORTER2
    assert {w: stem.porter(w) for w in PORTER} == PORTER


#: Nouns of clinical texts with their singulars; a noun alone is its own.
NOUNS = """abdomen specimen regimen semen lumen foramen stamen putamen cerumen acumen women:woman men:man policemen:policeman firemen:fireman headaches:headache aches:ache backaches:backache toothaches:toothache stomachaches:stomachache
    patches:patch watches:watch branches:branch inches:inch crutches:crutch stitches:stitch speeches:speech rashes:rash washes:wash lashes:lash flushes:flush diabetes series species pancreas atlas bias gas rabies scabies caries herpes measles mumps biceps triceps forceps pus
    biopsies:biopsy arteries:artery allergies:allergy injuries:injury studies:study therapies:therapy surgeries:surgery infirmaries:infirmary bodies:body families:family histories:history deficiencies:deficiency movies:movie calories:calorie ties:tie pies:pie
    masses:mass abscesses:abscess illnesses:illness weaknesses:weakness processes:process glasses:glass losses:loss viruses:virus sinuses:sinus fetuses:fetus uteruses:uterus thrombuses:thrombus bonuses:bonus causes:cause houses:house spouses:spouse clauses:clause uses:use pauses:pause
    doses:dose noses:nose roses:rose overdoses:overdose diagnoses:diagnosis prognoses:prognosis stenoses:stenosis thromboses:thrombosis psychoses:psychosis neuroses:neurosis fibroses:fibrosis necroses:necrosis metastases:metastasis analyses:analysis paralyses:paralysis prostheses:prosthesis hypotheses:hypothesis syntheses:synthesis pareses:paresis crises:crisis axes:axis testes:testis
    diseases:disease cases:case phases:phase bases:base nurses:nurse pulses:pulse responses:response courses:course increases:increase bruises:bruise lenses:lens reflexes:reflex boxes:box indexes:index complexes:complex sizes:size prizes:prize quizzes:quiz
    feet:foot teeth:tooth children:child mice:mouse lice:louse vertebrae:vertebra bursae:bursa bacteria:bacterium criteria:criterion phenomena:phenomenon ganglia:ganglion atria:atrium nuclei:nucleus bronchi:bronchus stimuli:stimulus emboli:embolus thrombi:thrombus foci:focus bacilli:bacillus calculi:calculus sulci:sulcus menisci:meniscus appendices:appendix matrices:matrix cervices:cervix cortices:cortex
    lives:life wives:wife knives:knife halves:half calves:calf leaves:leaf shelves:shelf nerves:nerve valves:valve sleeves:sleeve toes:toe shoes:shoe potatoes:potato tomatoes:tomato echoes:echo heroes:hero
    falls:fall seizures:seizure tremors:tremor veins:vein lungs:lung kidneys:kidney eyes:eye arms:arm legs:leg spells:spell days:day boys:boy x-rays:x-ray muscles:muscle tissues:tissue vaccines:vaccine enzymes:enzyme symptoms:symptom signs:sign tests:test results:result hours:hour weeks:week
    diagnosis sepsis paralysis virus sinus stress mass abscess uterus fetus pelvis cervix thorax stroke pain fever blood nausea vertigo oedema asthma eczema trauma as is us gas"""


def test_nouns():
    want = {w.split(":")[0]: w.split(":")[-1] for w in NOUNS.split()}
    assert len(want) > 190 and {w: stem.noun(w) for w in want} == want


def test_words_kept_from_stemming(spark):
    df = spark.createDataFrame([([["parkinsonism", "falls"]],)], "s array<array<string>>")
    assert df.select(stem.stem_nested("s", keep=("parkinsonism",))).first()[0] == [["parkinsonism", "fall"]]
    assert df.select(stem.stem_nested("s")).first()[0] != [["parkinsonism", "fall"]]


def test_stems_in_arrow(spark):
    df = spark.createDataFrame([([["falls", "no"], []],), (None,)], "s array<array<string>>")
    assert [r[0] for r in df.select(stem.stem_nested("s")).collect()] == [[["fall", "no"], []], None]


def flags(spark, sents, *cols):
    return tuple(spark.createDataFrame([(sents,)], "s array<array<string>>").select(*cols).first())


def test_negation_stays_in_its_sentence(spark):
    s = [["no", "tremor", "hand"], ["hand", "tremor"], ["histori", "of", "fall"]]
    yes, no = match.bag_negated("s", "hand tremor", ["no"])
    assert flags(spark, s, yes, no, match.bag("s", "fall hand"), match.bag_with("s", "fall", ["histori"])) == (1, 1, 0, 1)
    assert flags(spark, [], yes, no) == (0, 0)
    assert flags(spark, None, match.bag("s", "x")) == (0,)
    # a negator of two words is compared with single words and never fires
    yes, no = match.bag_negated("s", "fall", ["histori of"])
    assert flags(spark, s, yes, no) == (1, 0)


def test_windowed_scope(spark):
    far = ["no", "a", "b", "c", "d", "fall"]
    s = [[far], [["no", "a", "b", "c", "d", "e", "fall"]], [["fall", "was", "exclud", "x"]], [["not", "onli", "fall", "x", "y"]]]
    df = spark.createDataFrame([(x,) for x in s], "s array<array<string>>")
    got = [[tuple(y) for y in r[0]] for r in df.select(match.windowed("s", ["fall"], stem.porter2)).collect()]
    assert got == [[("fall", 0, 1)], [("fall", 1, 0)], [("fall", 0, 1)], [("fall", 1, 0)]]


words = st.lists(st.sampled_from(["no", "not", "only", "rule", "out", "ruled", "pain", "fall", "free", "of", "absent"]), max_size=9)


@settings(max_examples=60, deadline=None)
@given(words)
def test_scopes_lie_within_the_window(tokens):
    for a, b in match.scopes(tokens, match.trigger_table(match.BEFORE, match.AFTER, match.PSEUDO)):
        assert 0 <= a <= b <= len(tokens) and b - a <= match.WINDOW


@pytest.mark.parametrize(("sentence", "negated"), [
    ("no a b c d e f", "no a b c d e"),  # five words on
    ("a b c d e f absent", "b c d e f absent"),  # five words back
    ("negative a b", "negative a b"),  # of both kinds: before
    ("a negative", "negative"),
    ("x rule out a", "out a"),  # a phrase negates from its last word
    ("a b ruled out c", "a b ruled"),
    ("a b ruled out", ""),  # a phrase doesn't count at the very end
    ("not only a b", ""),  # a pseudo trigger lifts what was read before it
    ("not only a b absent", "not only a b absent"),  # and nothing later
    ("no not only a", ""),
    ("unremarkable for a", "for a"),
    ("", ""),
])
def test_scopes_of_sentences(sentence, negated):
    words = sentence.split()
    table = match.trigger_table(match.BEFORE, match.AFTER, match.PSEUDO)
    held = {i for a, b in match.scopes(words, table) for i in range(a, min(b + 1, len(words)))}
    assert " ".join(w for i, w in enumerate(words) if i in held) == negated


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abAB .,\n-é'", max_size=40))
def test_cleaning_matches_a_plain_restatement(s):
    import pyspark.sql

    spark = pyspark.sql.SparkSession.getActiveSession()
    want = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9 \n.]", "", s)).strip(" ").lower()
    assert spark.range(1).select(text.clean_standard(F.lit(s))).first()[0] == want
