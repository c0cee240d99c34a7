"""Sentence boundaries across languages and scripts by a pushdown automaton.

One pass over the marks of a text (terminators, quotes, brackets, line ends) with a stack of open quotations, brackets and list levels.
Terminators inside an open quotation or bracket never end the sentence; what closes it may. A line with a list mark opens a level of its
depth and closes all deeper ones together with what was left open inside them; a line that is not deeper than the level leaves it.
Abbreviations are looked up in a trie read backwards from the full stop. Line ends count as white space unless the next word would still have fitted on
the line, which tells headings, greetings and list items from wrapped prose. Texts in Thai, which has no full stop, end
sentences at spaces that do not belong to a number. A name with a mark of its own shows by what follows in lower case in a text whose sentences begin in upper case.

Texts are whole; nothing is cut to a prefix, and the work is linear in the text: the places of closing marks are noted once. Nulls and blank texts have no sentences.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on, without their last full stop.
GOES_ON = """
Mr Mrs Ms Dr Prof Rev Sgt Lt Capt Col Gen St Hon Sen Rep Gov Fr Mt vs cf fig figs pp p vol vols no nos ed eds e.g i.e viz approx al
Sr Sra Srta D Dña Ud Uds núm pág p.ej p. ej M MM Mme Mlle Mgr p.ex p. ex c.-à-d
z.B z. B d.h d. h bzw Nr Hr Fr Frau Hrn Bd S u.a u. a ca vgl Abb
т.е т. е т ул д г-н г-жа стр см рис им
π.χ π. χ κ κα κος δρ βλ σελ
د أ م ص डॉ श्री पं
"""
#: Abbreviations that end a sentence when the next one begins like one.
MAY_END = """
etc a.m p.m a. m p. m usw u.s.w и т. д и т.д и т. п т.д т.п др г гг κ.λπ κ.ά κτλ Jr Inc Ltd Co Corp U.S U.K Ph.D
"""
#: Months after an ordinal number with full stop.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember".split()
#: Words that take a clause up after three dots.
TAKES_UP = frozenset("or and but ou et mais y o pero oder und aber и или но ή και".split())
#: How a speaker clause begins after its quotation, where letter case does not tell.
SPEAKS = frozenset(
    "said asked shouted wrote replied answered cried whispered added called muttered sagte fragte rief schrieb dijo preguntó gritó respondió "
    "dit demande répète répond crie φωνάζει λέει ρωτά είπε говорит сказал сказала спросил спросила "
    "قال قالت سأل سألت صاح صاحت أجاب أجابت".split()
)
SPEAKER_CLAUSE = (
    re.compile(r"と(?:[^。！？\n]{0,12})(?:言|書|答|叫|聞|尋|思|話)"),
    re.compile(r"[^。！？，\n「『“]{1,8}(?:说|問|问|道|喊|答|叫|写道)(?=[。！？，：]|$)"),
    re.compile(r"[\p{L}\p{M}]++\s+(?:बोली|बोला|बोले|पूछा|कहा|कहती|पूछती)"),
    re.compile(r"[\p{L}\p{M}]++\s(?:ने\s)?(?:कहा|पूछा)"),
)

PAIRS = {"“": "”", "‘": "’", "«": "»", "„": "“", "‚": "‘", "「": "」", "『": "』", "《": "》", "(": ")", "[": "]", "（": "）", "【": "】"}
QUOTES = frozenset("“‘«„‚「『《\"")
CLOSERS = frozenset(PAIRS.values()) | {'"'}
STOPS = ".!?…‥。！？｡।॥؟۔"
EVENT = re.compile(r"[" + re.escape(STOPS) + r";;]+(?:[\s ]?[!?])*|[\"“”‘’«»„‚「」『』《》()\[\]（）【】]|\n")
THAI_EVENT = re.compile(r"[" + re.escape(STOPS) + r"]+|[\"“”‘’«»()\[\]]|\s+")
MARKER = re.compile(r"(?:[-*•–‣▪◦·]|\(?\d+[.)]|\(?[a-z][)])\s+(?=\S)")
MARK_ALONE = re.compile(r"(?:[-*•–‣▪◦·]|\(?\d+[.)]|\(?[a-z][)])\s*")
BULLET = re.compile(r"[*•‣▪◦·]\s+\S")
SPLIT_ABBREVIATION = re.compile(r"\.\s?\p{L}{1,2}\.")
BLANK = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
FULL_STOP_INSIDE = re.compile(r"[\p{Ll}\d]{2}[.!?]+\p{Lu}(?:\p{Ll}|\s|\.\s)")
NUMBER = re.compile(r"[$€£¥#№v]?\d[\d.,:\-–/%]*$")
#: The longest heading or greeting; list lines shorter than this are taken as lines of their own even if no line of the text is longer.
LEAST_WIDTH = 50
#: Stands in the stack for a list level, where quotations and brackets have their closing mark.
LEVEL = ""
_WORD, _LETTERS = re.compile(r"\S+"), re.compile(r"[\p{L}\p{M}]+")
_LETTER = re.compile(r"\p{L}")
_FOLLOWED = re.compile(r"\p{L}{2}([.!?])\s+(?:[-*•]\s)?([\p{Ll}\p{Lu}])")
_VISIBLE, _CLOSER = re.compile(r"\S"), re.compile(r"[\"”’»“‘」』》)\]）】]")
_GREEK, _THAI = re.compile(r"\p{Greek}"), re.compile(r"\p{Thai}")


def _trie(words: str, others: str) -> dict:
    """Characters backwards to nodes; a node's "" says whether the sentence may end there."""
    root: dict = {}
    for text, may_end in ((words, False), (others, True)):
        multi = [w for line in text.strip().split("\n") for w in _entries(line)]
        for w in multi:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = may_end
    return root


def _entries(line: str) -> list[str]:
    """Entries are separated by blanks; a part that ends in a full stop goes with the next part."""
    out: list[str] = []
    carry = ""
    for part in line.split():
        if part.endswith(".") or part == "и":
            carry += part + " "
        else:
            out.append(carry + part)
            carry = ""
    return out


TRIE = _trie(GOES_ON, MAY_END)


def abbreviation(text: str, stop: int, low: int) -> bool | None:
    """Of the full stop at ``stop``: None if no abbreviation ends there, else whether the sentence may end with it."""
    node, k, found = TRIE, stop - 1, None
    while k >= low:
        c = " " if text[k].isspace() else text[k]
        nxt = node.get(c) or node.get(c.lower() if found is None and c.isupper() else c)
        if nxt is None:
            break
        node = nxt
        if "" in node and (k == low or not (text[k - 1].isalnum() or unicodedata.category(text[k - 1])[0] == "M")):
            found = node[""]
        k -= 1
    return found


class Segmenter:
    """The automaton's run over one text."""

    def __init__(self, text: str):
        self.text = text
        letters = sum(map(str.isalpha, text)) or 1
        self.greek = len(_GREEK.findall(text)) > 0.3 * letters
        self.thai = len(_THAI.findall(text)) > 0.3 * letters
        self.width = max(map(len, (line.strip() for line in text.split("\n"))), default=0)
        self.lower = self._lower_style()
        self.out: list[tuple[int, int]] = []
        self.seen = (-1, -1)  # a place and the first visible character from there
        self.closers: dict[str, list[int]] = {}
        for m in _CLOSER.finditer(text):
            i, c = m.start(), m.group()
            if c != "’" or not text[i + 1 : i + 2].isalpha():  # else an apostrophe
                self.closers.setdefault(c, []).append(i)

    def _lower_style(self) -> bool:
        """Whether sentences of this text begin in lower case. What follows a capitalised word with a mark of its own tells nothing, nor does what follows an abbreviation."""
        low = up = 0
        for m in _FOLLOWED.finditer(self.text):
            at = m.start(1)
            if abbreviation(self.text, at, 0) is not None:
                continue
            if m.group(2).isupper():
                up += 1
                continue
            if m.group(1) != ".":
                k = m.start()
                while k and self.text[k - 1].isalpha():
                    k -= 1
                if self.text[k].isupper():
                    continue
            low += 1
        first = _LETTER.search(self.text)
        starts_low = bool(first and first.group().islower())
        return low > 0.1 * (low + up) or (low == up and starts_low)

    def emit(self, a: int, b: int) -> None:
        part = self.text[a:b]
        s = part.strip()
        if s:
            a += len(part) - len(part.lstrip())
            self.out.append((a, a + len(s)))

    def first_visible(self, a: int) -> int:
        """The first character from ``a`` on that is no white space (the text's length if there is none)."""
        if self.seen[0] != a:
            m = _VISIBLE.search(self.text, a)
            self.seen = (a, m.start() if m else len(self.text))
        return self.seen[1]

    def blank(self, a: int, b: int) -> bool:
        return self.first_visible(a) >= b

    def only_marker(self, a: int, b: int) -> bool:
        """Whether nothing but a list mark stands between two places."""
        at = self.first_visible(a)
        return at < b and MARK_ALONE.fullmatch(self.text, at, b) is not None

    def run(self) -> list[tuple[int, int]]:
        at = 0
        for m in BLANK.finditer(self.text):
            self.block(at, m.start())
            at = m.end()
        self.block(at, len(self.text))
        return self.out

    def enter_line(self, stack: list[tuple[str, int, bool]], a: int, b: int) -> None:
        """A line on its own begins at ``a``: leaves the list levels it is not below, with all that is open inside them, and opens its own if it has a mark."""
        head = self.first_visible(a)
        depth = head - a
        while stack and (stack[-1][0] != LEVEL or stack[-1][1] >= depth):
            stack.pop()
        if head < b and MARKER.match(self.text, head, b):
            stack.append((LEVEL, depth, True))

    def block(self, a: int, b: int) -> None:
        if a >= b or not self.text[a:b].strip():
            return
        if self.thai:
            self.thai_block(a, b)
            return
        t = self.text
        start = a  # of the current sentence
        stack: list[tuple[str, int, bool]] = []  # closing mark, where it opened, whether that began the sentence; or a list level with its depth
        self.enter_line(stack, a, b)
        skip_to = a
        while (m := EVENT.search(t, skip_to, b)) is not None:
            i, mark = m.start(), m.group()
            c = mark[0]
            skip_to = m.end()
            if c == "\n":
                if self.breaks(i, a, b, start, stack):
                    self.emit(start, i)
                    start = i + 1
                    self.enter_line(stack, start, b)
                continue
            inside = bool(stack) and stack[-1][0] != LEVEL
            if inside and c == stack[-1][0] and not (c == "’" and i + 1 < b and t[i + 1].isalpha()):
                _, opened, began = stack.pop()
                if stack and stack[-1][0] != LEVEL:
                    continue
                end = self.closed(i, opened, began, b)
                if end:
                    self.emit(start, end)
                    start = skip_to = end
                continue
            if c in PAIRS or c == '"':
                close = PAIRS.get(c, c)
                if self.opens(i, a, b, c, close):
                    stack.append((close, i, self.blank(start, i) or self.only_marker(start, i)))
                continue
            if c in CLOSERS or inside:
                continue
            end = self.stops(i, m.end(), start, b, mark)
            if end:
                self.emit(start, end)
                start = skip_to = end
        self.emit(start, b)

    def opens(self, i: int, a: int, b: int, c: str, close: str) -> bool:
        """Whether a mark opens something that closes again in this block."""
        if c in "‘‚" and i > a and self.text[i - 1].isalnum():
            return False
        places = self.closers.get(close, ())
        k = bisect_right(places, i)
        return k < len(places) and places[k] < b

    def breaks(self, i: int, a: int, b: int, start: int, stack: list[tuple[str, int, bool]]) -> bool:
        """Whether the line end at ``i`` ends a unit."""
        t = self.text
        head = max(a, t.rfind("\n", a, i) + 1)
        tail = t.find("\n", i + 1, b)
        line, rest = t[head:i].strip(), t[i + 1 : tail if tail >= 0 else b]
        following = rest.strip()
        if not line or not following:
            return False
        word = following.split(None, 1)[0]
        needed = len(line) + 1 + (1 if unicodedata.category(word[0]) == "Lo" and not word.isascii() else len(word))
        fits = needed <= self.width
        if BULLET.match(following):
            return True
        depth = len(rest) - len(rest.lstrip())
        leaves = any(close == LEVEL and depth <= at for close, at, _ in stack) and (self.lower or not word[0].islower())
        if MARKER.match(following) or leaves:
            return fits or needed <= LEAST_WIDTH or (line[-1] in STOPS and not MARKER.match(line))
        # a heading or greeting fills its line alone, and what follows begins like a sentence of this text
        alone = self.blank(start, head) and len(line) <= LEAST_WIDTH and " " in line
        if not fits or not alone or not (word[0].isupper() or (self.lower and word[0].islower()) or not word[0].isalpha()):
            return False
        return not (line[-1] in STOPS or line[-1] in CLOSERS) or line[-1] == ","

    def begins(self, k: int, b: int) -> tuple[int, str]:
        """Place of the next character that is no white space and its kind: upper, lower, caseless, digit, open, end or other."""
        t = self.text
        while k < b and t[k].isspace():
            k += 1
        if k >= b:
            return k, "end"
        c = t[k]
        if c.isupper() or c.istitle():
            return k, "upper"
        if c.islower():
            return k, "lower"
        if c.isalpha():
            return k, "caseless"
        if c.isdigit():
            return k, "digit"
        if c in PAIRS or c in '"¿¡':
            return k, "open"
        return k, "dash" if c in "—–" else "other"

    def word(self, k: int, b: int) -> str:
        m = _LETTERS.match(self.text, k, b)
        return m.group() if m else ""

    def stops(self, i: int, end: int, start: int, b: int, mark: str) -> int:
        """End of the sentence whose terminator stands at ``i``, or 0."""
        t = self.text
        c = mark[0]
        if c in ";;" and not self.greek:
            return 0
        while end < b and t[end] in CLOSERS and not (t[end] in "“‘\"" and end + 1 < b and not t[end + 1].isspace()):
            end += 1  # an unmatched closing mark still belongs to the sentence
        k, kind = self.begins(end, b)
        if c in "。！？｡।॥" or (c == "…" and mark.startswith("……")):
            return end
        gap = k > end
        if kind == "end":
            return end
        if not gap:
            if c in "؟۔":
                return end
            return end if kind == "upper" and FULL_STOP_INSIDE.match(t, max(start, i - 2), b) else 0
        if self.blank(start, i):  # nothing but the mark
            return 0
        if self.only_marker(start, k):
            return 0
        dots = mark.startswith(("...", "…"))
        if mark == ".":
            before = t[i - 1] if i > start else ""
            kept = abbreviation(t, i, start)
            if kept is False:
                return 0
            if kept is True:
                return end if kind in ("upper", "open", "caseless", "other") or (self.lower and kind == "lower" and before not in "гд") else 0
            alone = before.isalpha() and (i - 2 < start or not t[i - 2].isalnum())
            if alone and (before.isupper() or SPLIT_ABBREVIATION.match(t, i, b)):
                return 0  # an initial, or the first part of an abbreviation of several
            if before.isdigit() and self.word(k, b).lower() in MONTHS:
                return 0
        if kind == "lower":
            if not self.lower:
                return 0
            if dots and self.word(k, b) in TAKES_UP:
                return 0
            return end
        return 0 if kind == "dash" and not MARKER.match(t, k, b) else end

    def closed(self, i: int, opened: int, began: bool, b: int) -> int:
        """End of the sentence that a closing mark at ``i`` may end, or 0."""
        t = self.text
        end = i + 1
        k = i - 1
        while k > opened and (t[k].isspace() or t[k] in CLOSERS):
            k -= 1
        ended = t[k] in STOPS or (self.greek and t[k] in ";;")
        nxt, kind = self.begins(end, b)
        if kind == "end":
            return 0
        if not ended:
            return 0
        if t[k] == "." and not began and abbreviation(t, k, opened) is not None and kind != "upper":
            return 0
        if kind in ("lower", "upper", "caseless"):
            if self.word(nxt, b) in SPEAKS or any(p.match(t, nxt, b) for p in SPEAKER_CLAUSE):
                return 0
            if kind == "lower":
                quote = t[opened] in QUOTES
                return end if self.lower and began and (quote or t[opened] in "([（") else 0
            return end
        if kind in ("open", "digit"):
            return end
        if kind == "dash":
            return end if MARKER.match(t, nxt, b) and "\n" in t[end:nxt] else 0
        return end if MARKER.match(t, nxt, b) else 0

    def thai_block(self, a: int, b: int) -> None:
        t, start, depth = self.text, a, []
        space = a  # where the white space before the last word ends
        for m in THAI_EVENT.finditer(t, a, b):
            i, c = m.start(), m.group()[0]
            if i < start:
                continue
            if c.isspace():
                before, space = t[max(space, start) : i], m.end()
                if depth:
                    continue
                k, kind = self.begins(m.end(), b)
                after = _WORD.match(t, k, b)
                after = after.group() if after else ""
                if not before or self.only_marker(start, k):
                    continue
                if NUMBER.match(after) or NUMBER.match(before) or before.endswith("ว่า"):
                    continue
                self.emit(start, i)
                start = m.end()
            elif depth and c == depth[-1]:
                depth.pop()
            elif c in PAIRS or c == '"':
                if self.opens(i, a, b, c, PAIRS.get(c, c)):
                    depth.append(PAIRS.get(c, c))
        self.emit(start, b)


def segment(text: str | None) -> list[tuple[int, int]]:
    """Start and end (code points) of every sentence of a text, in order."""
    if text is None or not text.strip():
        return []
    return Segmenter(text).run()


def sentences(df: DataFrame, text: str, *keep: str, once: bool = False) -> DataFrame:
    """``(*keep, start_pos, end_pos)``: one row for each sentence of column ``text``; ``keep`` columns are carried along.

    With ``once`` rows equal in ``keep`` are deliveries of one text, which comes once: what is shuffled to tell are places, never texts.
    """
    types = [df.schema[c].dataType.simpleString() for c in keep]
    places = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segment(t) for t in b.column(0).to_pylist()]
            flat = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(places.value_type))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(ends), rows, type=places)], names=[*keep, "_at"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, types, strict=True)), "_at array<struct<start_pos int, end_pos int>>"])
    found = df.where(df[text].isNotNull()).select(text, *keep).mapInArrow(split, schema)
    if once:
        found = found.groupBy(*keep).agg(F.first("_at").alias("_at"))
    return found.select(*keep, F.inline("_at"))
