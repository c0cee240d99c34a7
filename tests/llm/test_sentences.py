"""Sentence boundaries on written cases and invariants on any text."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm.sentences import segment, sentences

CASES = [  # sentences of a text, divided by |
    "Dr. Smith met Prof. Jones at 9 a.m. | They left.", "He paid $3.50 in all, cf. fig. 2 and pp. 3-5. | Next one!", "J. B. Lane wrote it, e.g. in no. 4, but I did not. | Yes?",
    "“Go away!” shouted Ann, loudly. | Bob left.", "“We copied it.” | They left.", "He said (what a day!) that it rained. | Then it stopped.", "(It rained, see vol. 3.) | Then it stopped.",
    "I waited... or so the late lantern said. | It ended.", "It cost 5. | We paid.", "See www.a-b.example/c.html for more. | Thanks.",
    "Version 2.1 of file.v2.txt arrived.| Good.", "they left. | we stayed. | it rained etc. | nobody came.", "The end came.This is new.", "We saw it?? | Really!!",
    "Am 15. Mai kam er z. B. bei Dr. Lang an. | Er blieb usw. | Dann ging er.", "„Das ist gut!“, rief Prof. Lang. | Er ging.", "La Sra. Paz y el Sr. Gil dicen que sí. | ¿No?",
    "«\xa0Bonjour\xa0!\xa0» répète M. Paul. | Il part.", "В 1904 г. он ушёл и т. д. | Она жила на ул. Новой, д. 5. | Всё.", "«Иди!» — сказал он. | Она ушла.", "Πού είναι; | Εδώ, π.χ. στην πόλη.",
    "«Έλα!» φωνάζει η μητέρα. | Ήρθε.", "वह आई। | “चलो!” माँ बोली। | डॉ. राम गए।", "قالت د. سلمى نعم. | هل جاء؟ | «تعال!» قالت الجارة. | ذهب.",
    "他来了。|“走吧！”老师说。|（真的。）|好！？", "「町。」と先生は言った。|彼は来た（90）。", "เขามา | ครูอ่าน 60 คน | “เขาไป” | เธอกลับ",
    "Hello Ann,\n\n| We left\nearly today.", "Notes on the Door\n\n|It closed. |\n\nSent from my slate, please wait.", "We met.\n|* the cat\n|* a dog\n|We left.", "1. first\n|2. second",
    "1. bread (white\n|2. cheese\n|   a) hard) one\n|   b) soft\n|3. tea",  # what an item leaves open ends with its level
    "1204. the old ledger\n|1205. the new one", "We met.\n|- one item that goes on\n  below its mark\n|- other\n|We left it there.",
]


def _parts(case):
    text = case.replace(" | ", " ").replace("|", "")
    return text, [p.strip() for p in case.split("|")]


@pytest.mark.parametrize("case", [c for c in CASES if "new." not in c])
def test_cases(case):
    text, want = _parts(case)
    assert [text[a:b] for a, b in segment(text)] == want


def test_missing_blank():
    text = "The end came.This is new."
    assert [text[a:b] for a, b in segment(text)] == ["The end came.", "This is new."]


def test_wrapped_lines_do_not_end_sentences():
    text = "The old house on the hill that nobody had wanted to buy was\nsold. A new family came from the other side of the river in\nMay."
    assert len(segment(text)) == 2


@given(st.text(st.sampled_from("aA b.!?\n\"“”‘’()「」。，1-* ’éกخ"), max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text_is_covered_in_order(text):
    at, out = 0, segment(text)
    for a, b in out:
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


@given(st.from_regex(r"[A-Z][a-z]{2,9}[!?]", fullmatch=True), st.from_regex(r"[a-z]{3,9}", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_names_with_a_mark_of_their_own(name, word):
    text = f"The {name} {word} closed early. We left."
    assert [text[a:b] for a, b in segment(text)] == [f"The {name} {word} closed early.", "We left."]


@pytest.mark.parametrize("piece", ["5 [b “c ", "“a.”b", "(a. ", "\n- x (", "a’b ‘c ", "  \n", "1. ", "ก ข(", ". ", "”)] "])
def test_time_grows_with_the_text(piece):
    def took(n):
        began = time.process_time()
        segment(piece * n)
        return time.process_time() - began
    took(1_000)
    assert min(took(40_000) for _ in range(2)) < 3.5 * min(took(20_000) for _ in range(2)) + 0.1


def test_rows(spark):
    rows = [("k", "1", "One. Two."), ("k", "2", None), ("k", "3", "  "), ("k", "4", ""), ("k", "5", "x" * 200_000 + ". End.")]
    df = spark.createDataFrame(rows, "side string, doc_id string, text string").selectExpr("*", "1 as start_pos_", "'c' as clash")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences(df, "text", "side", "doc_id").collect())
    assert got == [("1", 0, 4), ("1", 5, 9), ("5", 0, 200_001), ("5", 200_002, 200_006)]
    assert sentences(df.where("false"), "text", "doc_id").count() == 0
    twice = sorted((r.doc_id, r.start_pos) for r in sentences(df.union(df), "text", "side", "doc_id", once=True).collect())
    assert twice == [x[:2] for x in got] and sentences(df.where("false"), "text", "doc_id", once=True).count() == 0
