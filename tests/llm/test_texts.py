"""Personal values, value mapping, sentences, tokens, mixing and spam pages."""

import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phenoframe.llm import bpe, deid, mixing, pagespam, pii, sentences, valuemap

JSON, RANKS = Path(bpe.VOCABULARIES, "byte_bpe_50k.json"), Path(bpe.VOCABULARIES, "byte_bpe_multi_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not JSON.exists(), reason="no vocabularies here")


def spans(text):
    return [(m.kind, text[m.start : m.end]) for m in pii.find(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("Seen with Dr. Anna B. Keller today.", [("name", "Anna B. Keller")]),
    ("The Dr. on call and the nurse agree.", []),
    ("Patient name KELLER, ANNA was confirmed.", [("name", "KELLER, ANNA")]),
    ("The Parkinson disease was negative; Kernig sign absent.", []),
    ("Her sister Maria drove to church. Maria waited.", [("name", "Maria"), ("name", "Maria")]),
    ("Call (555) 012-3456 or +44 20 7946 0738.", [("phone", "(555) 012-3456"), ("phone", "+44 20 7946 0738")]),
    ("Blood pressure was 120/103, lot 696-64, model 508-B, second 642 to 81030.", []),
    ("Results go to a.b+c (at) mail.example once.", [("email", "a.b+c (at) mail.example")]),
    ("Pain is rated 5 @ rest and 3 @ night.", []),
    ("MRN 881-26-82 and SSN 900-12-3456, passport Z5811258.", [("id_number", "881-26-82"), ("id_number", "900-12-3456"), ("id_number", "Z5811258")]),
    ("Lives at 402-A N. Elm Hill Close #5 with the son.", [("address", "402-A N. Elm Hill Close")]),
    ("Wohnhaft in der Lindenstraße 91 mit Frau Weber.", [("address", "Lindenstraße 91"), ("name", "Weber")]),
    ("Mme Claire Dubois habite 10 place de Verdun.", [("name", "Claire Dubois"), ("address", "10 place de Verdun")]),
    ("Domicilio en Avenida Roble 30. La Sra. Pérez vive aquí.", [("address", "Avenida Roble 30"), ("name", "Pérez")]),
    ("连絡先はab.cd@x.exampleである。", [("email", "ab.cd@x.example")]),
    ("Walks 21 yards along the lane behind Tansy House.", []),
    ("Emily's mother called.", [("name", "Emily")]),
    ("Maria Gonzalez arrived late. Physical Therapy reports gains.", [("name", "Maria Gonzalez")]),
    ("Seen in clinic: Olivia Parker, 34F, with cough.", [("name", "Olivia Parker")]),
    ("ID 4433221 was checked.", [("id_number", "4433221")]),
    ("Dr. Wu saw her. Mr. Lee came; Lee left.", [("name", "Wu"), ("name", "Lee"), ("name", "Lee")]),
    ("Пациент Иван Петров поступил вчера.", [("name", "Иван Петров")]),
    ("患者姓名：王小明。王小明今日出院。", [("name", "王小明"), ("name", "王小明")]),
    ("田中さんは来院した。患者さんは元気。", [("name", "田中")]),
    ("김민수 씨가 내원함. 의사 선생님이 보았다.", [("name", "김민수")]),
    ("السيد محمد جاء. الدكتور المناوب هنا.", [("name", "محمد")]),
    ("श्री राम ने कहा। डॉ. ने देखा।", [("name", "राम")]),
    ("คุณสมชาย มาพบแพทย์ คุณภาพดี", [("name", "สมชาย")]),
    ("Her MRN" + " " * 90 + "is 881-26-82.", [("id_number", "881-26-82")]),
    ("Mail " + "a" * 64 + "@" + "sub." * 40 + "clinic.example now.", [("email", "a" * 64 + "@" + "sub." * 40 + "clinic.example")]),
    ("Seen by Dr. A" + "nnamari" * 20 + " Keller.", [("name", "A" + "nnamari" * 20 + " Keller")]),
    ("", []), ("  \n", []),
])
def test_personal_values(text, want):
    assert spans(text) == want


def test_mentions_and_redaction(spark):
    df = spark.createDataFrame([(1, "Mail x@y.example, Mr. Orto Vel."), (2, None), (3, ""), (None, "Ms. Ada Lin"), (1, "Mail x@y.example, Mr. Orto Vel.")], "note_id long, note string").withColumn("kind", F.lit(0))
    got = sorted(((r["note_id"] or 0, r["kind"], r["start_pos"]) for r in deid.mentions(df, "note_id", "note").collect()))
    assert got == [(0, "name", 4), (1, "email", 5), (1, "email", 5), (1, "name", 22), (1, "name", 22)]
    assert [r["r"] for r in deid.redact(df, "note", "r").orderBy("note_id").collect()] == ["[NAME]".join(["Ms. ", ""]), *["Mail [EMAIL], Mr. [NAME]."] * 2, None, ""]
    with pytest.raises(ValueError):
        deid.redact(df, "note", "NOTE")
    assert deid.mentions(df.limit(0), "note_id", "note").count() == 0


def test_surrogates_keep_types_and_identity(spark):
    text = "Mr. Orto Velmar came, call 555-012-3456. MRN 881-26-82. Mail o.vel@y.example. Lives at 12 Elm Street."
    df = spark.createDataFrame([(1, text), (2, "VELMAR, ORTO"), (3, "Name: VELMAR, ORTO; tel. 555.012.3456, SSN 900-12-3456"), (4, None), (5, "nothing")], "note_id long, note string")
    got = {r["note_id"]: r["s"] for r in deid.surrogates(df, "note_id", "note", "s", "k1").collect()}
    assert got[4] is None and got[5] == "nothing" and set(got) == {1, 2, 3, 4, 5}
    one, three = pii.find(got[1]), pii.find(got[3])
    assert [m.kind for m in one] == [m.kind for m in pii.find(text)] and not any(x in got[1] for x in ("Velmar", "555-012", "881-26", "o.vel", "Elm"))
    name, upper = got[1][one[0].start : one[0].end], got[3][three[0].start : three[0].end]
    assert set(name.lower().split()) == set(upper.lower().replace(",", "").split()) and upper.isupper()
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(got[1][one[1].start : one[1].end]) == digits(got[3][three[1].start : three[1].end])
    other = {r["note_id"]: r["s"] for r in deid.surrogates(df, "note_id", "note", "s", "k2").collect()}
    assert other[1] != got[1]


def test_surrogates_of_formats_and_domains():
    """One number keeps its own digits in all formats; no label of a domain stays but the last; enough words in every script."""
    k = b"k"

    def digits(value):
        return "".join(c for c in deid.surrogate(k, "phone", value, {}) if c.isdigit())

    assert digits("+1 555 123 4567")[1:] == digits("+15551234567")[1:] == digits("(555) 123-4567") == digits("1-555-123-4567")[1:] != "5551234567"
    assert digits("+44 20 7946 0738")[2:] == digits("0044 20 7946 0738")[4:] == digits("020 7946 0738")[1:] and digits("+44 20 7946 0738")[:2] == "44"
    assert deid.tokens_of("email", "Anna.S (at) smith-family (dot) mail.example") == ["anna.s", "@smith-family", "@mail"]
    words = {"anna.s": "bo.mi7", "@smith-family": "dune", "@mail": "tol"}
    assert deid.surrogate(k, "email", "Anna.S (at) smith-family (dot) mail.example", words) == "bo.mi7 (at) dune (dot) tol.example"
    for token in ("김민수", "王小明", "たなか", "Smith", "محمد"):
        assert len({deid.name_token(k, f"{token}{i}", "u", 9) for i in range(2000)}) == 2000  # later attempts have room for any number


def test_check_of_replacements(spark):
    rows = [("name", "Ann", "Bo"), ("name", "ann", "bo"), ("name", "Eve", "Bo"), ("name", "Ann", "Cy"), ("email", "x@y", "z@q"), ("phone", "1", "2"), ("name", "Dan", "Eve")]
    made = spark.createDataFrame(rows, "kind string, value string, surrogate string")
    assert deid.surrogate_check(made).first().asDict() == {"reused": 1, "changing": 1, "leaked": 1}
    assert deid.surrogate_check(made.limit(0)).first().asDict() == {"reused": 0, "changing": 0, "leaked": 0}


def test_surrogate_words_are_distinct(spark):
    names = [(i, f"Mr. {a}{b}{c}", "u") for i, (a, b, c) in enumerate((x, y, z) for x in "BDFGK" for y in "aeiou" for z in ("lom", "ner", "vit", "sar"))]
    found = spark.createDataFrame([("name", n.removeprefix("Mr. "), "m") for _, n, _ in names], "kind string, value string, gender string")
    got = deid.surrogate_words(found, "s").collect()
    assert len(got) == 100 == len({r["word"] for r in got}) and not {r["word"] for r in got} & {r["token"] for r in got}


@settings(max_examples=50, deadline=None)
@given(st.sets(st.text("0123456789", min_size=5, max_size=5), min_size=2, max_size=40))
def test_digits_are_permuted(values):
    assert len({deid.permuted(b"k", v, "phone") for v in values}) == len(values)


def test_initials_and_house_numbers_stay_distinct():
    new = lambda kind, value, words: deid.surrogate(b"k1", kind, value, words)
    assert len({new("name", f"{c}. Velmar", {"velmar": "kodita"}) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) == 26
    assert len({new("name", f"{c}. Вельмар", {"вельмар": "кодита"}) for c in "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"}) == 27
    a = new("name", "A. Velmar", {"velmar": "kodita"})
    assert a[0].isupper() and a[0] != "A" and a[1:] == ". Kodita" and new("name", "a", {}) == a[0].lower() and "A" <= a[0] <= "Z"
    numbers = [new("address", f"{n} Elm Street", {"elm": "kodita"}).split()[0] for n in range(12000)]
    assert len(set(numbers)) == 12000 and all(len(x) == len(str(n)) and (x[0] == "0") == (n == 0) for n, x in enumerate(numbers))
    assert len({deid.house(b"k1", f"{n:05}") for n in range(2000)}) == 2000


REF = [(1, "velumodor", "Sidoxadaspyl"), (2, "haloplemate", None), (3, "praulotrinyl/toruphare", None), (4, "praulotrinyl", "Miroclovor"), (5, "toruphare", None), (6, None, "Brandonly"), (None, "nothingatall", None), (7, "velutakor", None)]


@pytest.mark.parametrize(("value", "ref"), [
    ("velumodor", 1), ("VELUMÓDOR 250 mg tab po bid", 1), ("velumdoor", 1), ("velu modor 5 mg", 1), ("Velumo-dor", 1), ("ve1umodor", 1), ("velumodor50mg", 1), ("velumo. XR", 1), ("Sidoxadaspyl (velumodor) 1 g", 1), ("1/2 tab haloplmeate", 2),
    ("toruphare and praulotrinyl 50-20", 3), ("praulotrinyl/toruphare", 3), ("toruphare", 5), ("Miroclovor + toruphare", 3), ("brandonly 2 mg", 6), ("velu", 0), ("velut", 7), ("herbal tea", 0), ("???", 0), ("12 mg", 0), ("veluplomide", 0),
])
def test_value_mapping(spark, mapped, value, ref):
    assert mapped[value] == ref


@pytest.fixture(scope="module")
def mapped(spark, request):
    values = [m.args[1][i][0] for m in [next(x for x in test_value_mapping.pytestmark if x.name == "parametrize")] for i in range(len(m.args[1]))]
    ref = spark.createDataFrame(REF, "ref_id long, canonical_name string, brand_name string")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(900, None), (901, "  ")], "med_id long, med_name string")
    got = valuemap.map_values(df, "med_name", ref, "ref_id", "canonical_name", "brand_name").collect()
    assert len(got) == len(set(values))
    return {r["value"]: r["ref_id"] for r in got}


def test_rows_and_reports_of_mapping(spark):
    ref = spark.createDataFrame(REF, "ref_id long, canonical_name string, brand_name string")
    df = spark.createDataFrame([(1, "velumodor"), (1, "velumodor"), (2, " "), (3, None), (4, "tea"), (5, "tea"), (None, "velumodor"), (6, "x" * 3000)], "med_id long, med_name string").withColumn("ref_id", F.lit(9))
    args = ("ref_id", "canonical_name", "brand_name")
    assert {tuple(r) for r in valuemap.map_rows(df, "med_id", "med_name", ref, *args).collect()} == {(1, 1), (4, 0), (5, 0), (6, 0)}
    assert {tuple(r) for r in valuemap.unmatched(df, "med_name", ref, *args).where("length(value) < 9").collect()} == {("tea", 2)}
    assert {r["ref_id"] for r in valuemap.map_rows(df, "med_id", "med_name", ref.limit(0), *args).collect()} == {0}
    assert valuemap.map_rows(df.limit(0), "med_id", "med_name", ref, *args).count() == 0


def test_prefix_join_finds_all_similar_words(spark):
    words = sorted({w[:k] + c + w[k + 1 :] for w in ("velumodor", "haloplemate", "toruphare") for k in range(1, 8, 3) for c in "xeo"})
    names = ["velumodor", "haloplemate", "toruphare", "velutakor"]
    want = {}
    for w in words:
        best = min((valuemap.distance(w, n, valuemap.allowed(len(n))), n) for n in names)
        if best[0] <= valuemap.allowed(len(best[1])):
            want[w] = best[1]
    got = valuemap.best_entries(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(n,) for n in names], "w string"))
    assert {r["word"]: r["entry"] for r in got.collect()} == want


QUOTED = "He said: \"" + "It hurts a lot. " * 60 + "I can't sleep.\" Then he left."


def test_sentences_by_property_and_without_bounds():
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for mark in regex.findall(r"\p{Sentence_Break=STerm}", every):
        text = f"Ab cd{mark} Ef gh{mark}"
        assert [text[a:b] for a, b in sentences.units(text)] == [f"Ab cd{mark}", f"Ef gh{mark}"], hex(ord(mark))
    for stop in regex.findall(r"\p{Sentence_Break=ATerm}", every):
        assert len(sentences.units(f"Ab cd ef{stop} Gh ij{stop}")) == 2, hex(ord(stop))
    assert [QUOTED[a:b][-14:] for a, b in sentences.units(QUOTED)] == ["I can't sleep.\""[-14:], "Then he left."] and len(QUOTED) > 900
    lost = "Widened to 5\" here. The pipe is old. She said \"no. Never.\" and left."
    assert [lost[a:b] for a, b in sentences.units(lost)] == ["Widened to 5\" here.", "The pipe is old.", "She said \"no. Never.\" and left."]
    nested = "«Он сказал «да. Нет» и ушёл. Потом» вернулся. Конец."
    assert [nested[a:b] for a, b in sentences.units(nested)] == ["«Он сказал «да. Нет» и ушёл. Потом» вернулся.", "Конец."]


@pytest.mark.parametrize(("text", "n"), [
    ("She takes vitamin B. It helps.", 2), ("He has hepatitis C. Follow up soon.", 2), ("Seen by J. Smith today.", 1), ("Anna B. Keller came.", 1), ("Come at 5 p.m. Tuesday for labs.", 1), ("Come at 5 p.m. Bring the list.", 2),
    ("We chose plan A. The rest waits.", 2), ("Spoke with M. R. Lopez. He agreed.", 2),
])
def test_capitals_and_hours(text, n):
    assert len(sentences.units(text)) == n


@pytest.mark.parametrize(("text", "want"), [
    ("He fell. She ran.", ["He fell.", "She ran."]),
    ("Seen by Dr. Smith at 7:54 a.m. in the clinic. It is 8.2 cm, i.e. small vs. large.", ["Seen by Dr. Smith at 7:54 a.m. in the clinic.", "It is 8.2 cm, i.e. small vs. large."]),
    ("Good effect.Please call.", ["Good effect.", "Please call."]),
    ("Mail a.b@c.example today. Bye", ["Mail a.b@c.example today.", "Bye"]),
    ('"It hurt. I fell," she said. Then rest.', ['"It hurt. I fell," she said.', "Then rest."]),
    ('He said, "I fell." She left.', ['He said, "I fell."', "She left."]),
    ("Takes it b.i.d. in May. Takes it q.h.s. Walks.", ["Takes it b.i.d. in May.", "Takes it q.h.s.", "Walks."]),
    ("It went... then stopped. And... Then?", ["It went... then stopped.", "And...", "Then?"]),
    ("Plan:\n1. rest\n2. water\n\nDone", ["Plan:", "1. rest", "2. water", "Done"]),
    ("one\ntwo. three\n\n\nfour", ["one\ntwo.", "three", "four"]),
    ("* rest\n- Walk. Run.\nThen home.", ["* rest", "- Walk. Run.", "Then home."]),
    ("Am 19. Juli kam sie, z. B. nachts. Haus 85. Ende", ["Am 19. Juli kam sie, z. B. nachts.", "Haus 85.", "Ende"]),
    ("Elle dit : « Ça va. Merci. » M. Roux rit !", ["Elle dit : « Ça va. Merci. »", "M. Roux rit !"]),
    ("Dijo: «Duele. Mucho». ¿Sí? ¡No!", ["Dijo: «Duele. Mucho».", "¿Sí?", "¡No!"]),
    ("妻は「倒れた。起きた。」と話した。歩行は改善！", ["妻は「倒れた。起きた。」と話した。", "歩行は改善！"]),
    ("家属说：「倒下。醒了。」步态好。", ["家属说：「倒下。醒了。」", "步态好。"]),
    ("डॉ. ने कहा। मात्रा 3 मि.ग्रा. की गई।", ["डॉ. ने कहा।", "मात्रा 3 मि.ग्रा. की गई।"]),
    ("т. е. вдвое, ок. 71 мин. и прошёл. Всё!", ["т. е. вдвое, ок. 71 мин. и прошёл.", "Всё!"]),
    ("أوصى د. المناوب. هل تحسن؟ نعم.", ["أوصى د. المناوب.", "هل تحسن؟", "نعم."]),
    ("น้ำหนัก 7.7 กก.จากเดิม ไม่พบ ให้ยา abc ขนาด", ["น้ำหนัก 7.7 กก.จากเดิม", "ไม่พบ", "ให้ยา abc ขนาด"]),
    ("", []), (" \n\t ", []), ("x" * 5000, ["x" * 5000]),
])
def test_sentence_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='aB. \n"「」。!?:1-«»', max_size=60))
def test_units_cover_all_but_blanks(text):
    u = sentences.units(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in u)
    assert all(x[1] <= y[0] for x, y in zip(u, u[1:], strict=False))
    assert "".join("".join(text[a:b].split()) for a, b in u) == "".join(text.split())


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (1, "A b. C d."), (None, "E")], "note_id long, note string").withColumn("u", F.lit(1))
    got = sorted((r["note_id"] or 0, r["start_pos"], r["end_pos"]) for r in sentences.split_sentences(df, "note_id", "note").collect())
    assert got == [(0, 0, 1), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]


SAMPLES = ["Hello world, it's 3.5 mg!", "", " ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|> hi", "naïve 日本語 🙂🏽 ไทย", "a\n\n\n  b\t", "\u0000�" * 9, "Donaudampfschifffahrt" * 40, "ab" * 3000]


@needs_vocabulary
def test_json_vocabulary_agrees_with_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(JSON))
    t.encode_special_tokens = True
    assert bpe.Encoder(bpe.Vocabulary.load(str(JSON)))(SAMPLES) == [x.ids for x in t.encode_batch(SAMPLES, add_special_tokens=False)]


@needs_vocabulary
@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_rank_vocabulary_agrees_with_the_library(texts):
    import tiktoken

    if not hasattr(test_rank_vocabulary_agrees_with_the_library, "both"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.read_bytes().splitlines())}
        test_rank_vocabulary_agrees_with_the_library.both = bpe.Encoder(bpe.Vocabulary.load(str(RANKS))), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, lib = test_rank_vocabulary_agrees_with_the_library.both
    assert own([*texts, *SAMPLES[:4]]) == [lib.encode_ordinary(t) for t in [*texts, *SAMPLES[:4]]]


@needs_vocabulary
def test_long_words_agree_and_end_soon():
    """Unbroken words beyond the bound of the matrices, by both kinds of list."""
    import random
    import time

    import tiktoken
    from tokenizers import Tokenizer

    r = random.Random(2)
    words = ["".join(r.choice("abcdeinrst") for _ in range(n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000)] + ["x" * 5001, "глава" * 900]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = Tokenizer.from_file(str(JSON))
    lists = [(bpe.Vocabulary.load(str(RANKS)), library.encode_ordinary), (bpe.Vocabulary.load(str(JSON)), lambda x: t.encode(x, add_special_tokens=False).ids)]
    for v, encode in lists:
        assert bpe.Encoder(v)(words) == [encode(w) for w in words]
    begun = time.time()
    bpe.Encoder(lists[0][0])(["".join(r.choice("abcdefghij") for _ in range(120_000))])
    assert time.time() - begun < 20


def test_a_table_tells_whether_places_may_be_merged_together():
    """(0 1) -> 3 and (3 2) -> 4 rank in order; with the ranks exchanged, merging the first may give rise to the second below it."""
    import numpy as np

    a = [np.array(x) for x in ([0, 3], [1, 2])]
    assert not bpe.Vocabulary(np.zeros(256), *a, np.array([0, 1]), np.array([3, 4])).leftmost
    assert bpe.Vocabulary(np.zeros(256), *a, np.array([1, 0]), np.array([3, 4])).leftmost


@needs_vocabulary
def test_encode(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world")], "doc_id long, text string")
    got = [(r["doc_id"], list(r["ids"])) for r in bpe.encode(df, "text").collect()]
    assert sorted(got) == [(1, got[[g[0] for g in got].index(1)][1])] * 2 + [(2, []), (3, [])]
    assert {r["doc_id"]: r["n"] for r in bpe.encode(df, "text", "n", count_only=True).collect()} == {1: 2, 2: 0, 3: 0}
    assert bpe.encode(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, "text", "TEXT")


def docs(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), (20 + F.col("id") * 37 % 200).alias("n"))


def test_mix_reaches_its_shares(spark):
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.3, 4), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    d = docs(spark).unionByName(spark.createDataFrame([(None, "big", 5), (77777, None, 5), (77778, "other", 5), (77779, "big", 0), (77780, "big", None)], "doc_id long, source string, n long"))
    got = mixing.mix(d, t, "doc_id", "source", "n")
    rep = {r["source"]: r for r in mixing.mix_report(got, d, t, "source", "n").collect()}
    assert rep["absent"]["share_reached"] == 0 and all(abs(rep[s]["share_reached"] - 1 / 3) < 0.01 for s in ("big", "mid", "small"))
    assert all(r["most_copies"] <= r["max_repeats"] and r["budget"] - 220 < r["tokens"] <= r["budget"] for s, r in rep.items() if s != "absent")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(d.repartition(7), t, "doc_id", "source", "n").collect()))
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and not {77777, 77778, 77779, 77780} & set(ids)


def test_mix_with_a_total_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED", 3)
    monkeypatch.setattr(mixing, "BINS", 8)
    t = spark.createDataFrame([("big", 1.0, 3)], "source string, target_share double, max_repeats int")
    d = docs(spark, 500)
    all_ = d.where("source = 'big'").agg(F.sum("n")).first()[0]
    got = mixing.mix(d, t, "doc_id", "source", "n", total=int(all_ * 1.5)).agg(F.sum(F.col("size") * F.col("copies")), F.max("copies"), F.min("copies")).first()
    assert all_ * 1.5 - 220 < got[0] <= all_ * 1.5 and (got[1], got[2]) == (2, 1)
    assert mixing.mix(d.limit(0), t, "doc_id", "source", "n").count() == 0
    assert mixing.mix(d, t.limit(0), "doc_id", "source", "n").count() == 0


def test_inclusion_follows_size(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 50).otherwise(200).alias("n"))
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    total = 6000 * 125 // 5
    share = {r["size"]: r["k"] / 3000 for r in mixing.mix(d, t, "doc_id", "source", "n", total=total).groupBy("size").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert 1.6 < share[200] / share[50] < 2.5


PROSE = "The patient walks well. She sleeps six hours a night and eats soup, bread and fruit without trouble. No falls were recorded this week."


@pytest.mark.parametrize(("text", "spam"), [
    (PROSE, False), (PROSE + "\nMore: https://guide.example/a/1", False), (None, False), ("", False), (" \n ", False),
    ("\n".join(["Home | Shop | Blog | Cart | Login | Terms buy pills", "Help » Tags » Shop » Home » Blog"] * 8), True),
    (", ".join(f"cheap item {i}" for i in range(40)), True), ("\n".join(["best pills", "buy drops"] * 20), True), ("\n".join(f"#tag{i}sale" for i in range(30)), True),
    ("brain tonic " * 60, True), ("Pills buy pills pills cheap pills. Pills best pills pills now pills. " * 9, True), ("buy-deal-pill-box best-drops-for-sale cheap-nerve-tonic-near " * 9, True),
    ("\n".join(f"Nerve Tonic REF{92000 + i} new order {i}.99" for i in range(20)), True), ("|".join(["睡眠サプリ", "通販", "格安"] * 20), True), ("\n".join(f"see http://x{i}.example/buy" for i in range(20)), True),
    ("LABORATORY DATA\n" + "\n".join(f"sodium\t{i}.1\t(2.0 - 8.{i})" for i in range(9)), False), ("Current medications:\n" + "\n".join(f"drug{i} {i}5 mg q.h.s." for i in range(9)), False),
    ("Problem list:\n" + "\n".join(f"{i}. mild nausea, right knee" for i in range(1, 9)), False), ("Visit schedule\n" + "\n".join(f"{i} May, 4:3{i}: gait analysis in the stroke unit" for i in range(1, 9)), False),
    (PROSE + "\n" + ", ".join(f"cheap item {i}" for i in range(60)), True),
])
def test_pages(text, spam):
    assert (pagespam.page_shapes(text)[1] > pagespam.MOST) is spam


def test_links_of_any_length_and_lists():
    anchor = '<a href="https://shop.example/x" title="' + "y" * 700 + '">' + "buy " * 120 + "</a>"
    assert pagespam.page_shapes("\n".join([anchor] * 20))[1] == 1.0
    assert pagespam.links("see [a b](http://x.example/q) and shop.example/buy now, not 3.5/day or [a](b c)") == [(4, 29), (34, 50)]
    assert pagespam.page_shapes("Ingredients: flour, sugar, butter, eggs, milk, salt, vanilla, cream\nTools: bowl, whisk, oven, spoon, pan, sieve, knife")[1] == 0.0
    assert pagespam.page_shapes("\n".join(f"{x} shoes" for x in "running trail tennis walking hiking golf court kids winter summer".split()))[1] == 1.0
    assert pagespam.page_shapes("Hypertension\nType 2 diabetes\nChronic kidney disease\nAtrial fibrillation\nOsteoarthritis of the knee\nMild anaemia\nGout\nAsthma")[1] == 0.0
    import time

    begun = time.time()
    for unit in ("<a ", "[", "](", "a.", "a.b/", "http://"):
        pagespam.page_shapes(unit * 60_000)
    assert time.time() - begun < 20


def test_flag_pages(spark):
    df = spark.createDataFrame([(1, "brain tonic " * 60), (1, "brain tonic " * 60), (2, PROSE), (3, None)], "doc_id long, text string").withColumn("flagged", F.lit("clash"))
    got = pagespam.flag_pages(df, "text")
    assert sorted((r["doc_id"], r["f"]) for r in got.select("doc_id", F.col("page_shape.flagged").alias("f")).collect()) == [(1, True), (1, True), (2, False), (3, False)]
    assert {r["n_flagged"] for r in pagespam.shape_report(got).collect()} == {2}
    assert pagespam.flag_pages(df.limit(0), "text").count() == 0


LONG = ["a." * 30_000, "A-" * 30_000, "1-" * 30_000, "a@" * 20_000, '"' * 50_000, "Mr. Orto Vel came. " * 3000, "a.b@c.example " * 3000, "<a " * 20_000, "[a](" * 20_000, "x y\n" * 20_000, 'He said, "I fell. So." It was. \n' * 2000, "ไทย " * 20_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_very_long_texts_take_no_time(text):
    import time

    began = time.time()
    found, u = pii.find(text), sentences.units(text)
    pagespam.page_shapes(text)
    assert time.time() - began < 20
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and "".join("".join(text[a:b].split()) for a, b in u) == "".join(text.split())


def test_a_role_before_initials():
    assert spans("Interpreter Casvik M. Lindelo was present.") == [("name", "Casvik M. Lindelo")]
