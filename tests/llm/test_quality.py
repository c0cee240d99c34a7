"""Kinds of texts on written cases, and any text measured without failing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import quality
from glyphmill.llm.quality import COLUMNS, CommonWords, kinds, measure, text_quality

WORDS = "the a of and to we she he they in on it that this der die und wir 的 了 在 我 は を に です".split()
PROSE = "She carried the old lantern to the harbour and waited there. They said that it would rain. We left the house in the evening."
CASES = {
    "prose": [PROSE, PROSE + "\n\n* one thing\n* other thing\n\n" + PROSE, "She left.", "We met the man on the road to the old town\nand he told us of it."],
    "list": ["- milk\n- bread\n- a large cheese\n- tea", "1. one\n2. two\n3. three\n4. four", "01 bread\n02 tea\n03 salt\n04 milk", "bread; tea; salt; milk; oil; rice; corn; jam", "Chapter ......... 12\nAnother ....... 19\nLast one ........ 40",
             "She bought it all.\n\nmilk\nbread\nsalt\npepper\ntea\nrice\noil"],
    "table": ["a\tb\tc\n1\t2\t3\n4\t5\t6", "x,y,z\n1,2,3\n4,5,6\n7,8,9", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "name: ann\nage: 31\nrank: 4\ntown: rome", "name      age\nann       31\nbob       42\neve       27",
              "+------+\n12 ann 3.4\n15 bob 7.1\n+------+\n19 eve 2.2"],
    "junk": ["=====\n~~~~~~~\n#####\n*****", "click here click here click here click here click here", "<div class=\"a\"><span>x</span></div>\n<div class=\"b\"><span>y</span></div>", "t h e  o l d  h o u s e  o n  t h e  h i l l", "a1 ff 03 9c 77 e0 1b 5d aa 90",
             "QmFzZTY0IGlzIG5vdCBwcm9zZSBhdCBhbGwgYnV0IG1hY2hpbmUgcmVzaWR1ZQ==", "wkow;gqd atoqt;yeia;g aska; ffl ugitp jukrd ;sfw sjlgtrp papioe; rk hwyhtph"],
}


COMMON = CommonWords(frozenset(WORDS))
#: Items without any mark, longer than a heading and of many lengths.
LONG_ITEMS = "\n".join([
    "Wooden ladders from northern workshops, second hand", "Brass lanterns with spare glass", "Four bicycle tyres, hardly used, green valves and pumps", "Copper kettles",
    "Printed maps showing railway lines before closure", "Leather saddles", "Theatre programmes", "Garden tools: rakes, forks, spades",
])
WRAPPED = """she carried the old lantern to the harbour and waited there for a
boat that nobody had seen since the last winter while the others on
the hill were singing and the rain went on and on over the roofs of
the town until he came down the road with bread and a letter for us
in which they said that it would be over soon and that we had to be"""


def one(text):
    return {c: v[0] for c, v in measure([text], COMMON).items()}


def kind(text):
    return kinds(measure([text], COMMON))[0]


@pytest.mark.parametrize("want,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(want, text):
    assert kind(text) == want


def test_texts_are_measured_alike_alone_and_together():
    texts = [t for ts in CASES.values() for t in ts] + [LONG_ITEMS, WRAPPED]
    together = measure(texts, COMMON)
    for k, t in enumerate(texts):
        assert all(v == pytest.approx(together[c][k]) for c, v in one(t).items()), t


def test_room_decides_on_lines_without_marks(monkeypatch):
    assert (kind(LONG_ITEMS), kind(WRAPPED)) == ("list", "prose")
    assert one(LONG_ITEMS)["room_autocorrelation"] > quality.ROOM > one(WRAPPED)["room_autocorrelation"]
    monkeypatch.setattr(quality, "room_autocorrelation", lambda room: 0.0)
    assert kind(LONG_ITEMS) != "list"


def test_indentation_decides(monkeypatch):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(("harbour", "lantern", "letter", "kettle", "the", "garden", "of", "winter", "station", "we", "that", "rumour")) for _ in range(n))
    hanging = "\n".join(f"- {some(5)}\n      {some(9)}." for _ in range(9))
    headed = "\n".join(f"{some(3)}\n    {some(3)}\n    {some(4)}" for _ in range(8))
    for text in (hanging, headed):
        assert kind(text) == "list" and one(text)["periodic_indent_share"] > 0.5
    monkeypatch.setattr(quality.Lines, "indentation_period", lambda self: self.stop & False)
    assert kind(hanging) != "list"


def test_repetition_of_any_period():
    words = [f"w{k}" for k in range(150)]
    assert one(" ".join(words * 4))["repeated_share"] == pytest.approx(0.75)
    assert kind("some words that head the text " + " ".join(words * 5)) == "junk"
    assert one(" ".join(words))["repeated_share"] == 0


def test_long_lines_are_measured_whole():
    assert kind("\n".join(f"field {k}: " + " ".join(f"word{j * 7 + k}" for j in range(60)) for k in range(4))) == "table"
    assert one("." * 300_000 + "x")["n_chars"] == 300_001


@given(st.lists(st.text(min_size=1).filter(lambda t: t.strip()), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_text_is_measured(texts):
    s = measure(texts, COMMON)
    assert set(s) == set(COLUMNS) and all(k in CASES for k in kinds(s))
    assert all((v >= 0).all() and (v <= 1.0001).all() for c, v in s.items() if c.endswith("_share") and c not in ("damage_share", "hex_share"))


def test_rows(spark):
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, " \n "), (4, ""), (5, "- a\n- b\n- c\n- d"), (5, "- a\n- b\n- c\n- d"), (6, "word " * 60_000)], "doc_id bigint, text string").selectExpr("*", "'x' as kind", "'y' as n_chars")
    words = spark.createDataFrame([(w,) for w in [*WORDS, None]], "word string")
    got = [(r.doc_id, r.kind, r.n_chars) for r in text_quality(df, words).orderBy("doc_id").collect()]
    assert got == [(1, "prose", len(PROSE)), (2, "blank", None), (3, "blank", None), (4, "blank", None), (5, "list", 15), (5, "list", 15), (6, "junk", 300_000)]
    assert text_quality(df.where("false"), words).count() == 0
