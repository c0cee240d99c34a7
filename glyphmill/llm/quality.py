"""Per-document text statistics and the kind of a text: prose, list, table or junk.

The lines of a batch of texts are laid end to end and measured as arrays. Tables show as delimiters that stand in like number and place
on line after line (vertical alignment). Lists show by their marks and the periodicity of their indentation (marks of one kind at one depth come back
at one distance, deeper lines hang on them), and, without any mark, by the autocorrelation of their line lengths about the text's width: wrapped prose fills its
lines, so the room left by one line and the next is small, while items leave room line after line. Word, symbol and punctuation
ratios tell items from clauses and make junk show: symbols, damage, single letters, repetition. A text's kind is what most of its characters belong to.
"""

from __future__ import annotations

import re as _re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSE = r"[\"”’»)\]』」）“'\s\x{A0}]*"
# patterns over line arrays (RE2)
STOP = r"[.!?…।॥؟۔]" + CLOSE + r"(?:[\s\x{A0}]|$)|[。！？।]"
ENDS = r"[.!?…。！？।॥؟۔:;;]" + CLOSE + "$"
MARKERS = (r"^[-*•–‣▪◦·+]\s+\S", r"^\(?\d{1,3}[.)]\s+\S", r"^\(?(?:[a-zA-Z]|[ivx]{1,4})\)\s+\S", r"^>\s+\S")
NUMBERED = r"^(?P<n>\d{1,9})\s+\S"
LEADER = r"\.{4,}\s*\S{0,8}\s*$|…{2,}\s*\d+\s*$"
KEY_VALUE = r"^[\pL\pN_.\- ]+[:=]\s*[^\s:=]"
NUMERIC = r"^[-+$€]?\d[\d.,:%/\-]*$|^\pL+_\d+$"
WORDY = r"[\pL\pN]"
SENTENCE_GAPS = r"[.!?。！？।]\s*"
# patterns over single texts that show signs of junk
TAG = _re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]{2,6};")
PIECE = _re.compile(r"<0x[0-9A-Fa-f]{2}>|(?<!\S)[Ġ▁Ċ]\S*")
SPACED = _re.compile(r"(?:(?<!\S)[^\W\d_] ){3,}[^\W\d_]?(?!\S)")
HEX = _re.compile(r"(?<!\S)[0-9a-fA-F]{2}(?!\w)")
SOLID = _re.compile(r"(?<!\S)[A-Za-z0-9+/]{40,}={0,2}(?!\S)|(?<!\S)(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{12,}==?(?!\S)")
DAMAGE = _re.compile(r"[ÃÂ][\x80-\xbf]|�|â\x80|[ÐÑ][\x80-\xbf]|[\x00-\x08\x0e-\x1f]")
DAMAGE_SIGNS = r"[ÃÂâÐÑ�\x00-\x08\x0e-\x1f]"
VOWEL = "[aeiouy]"
MASH = r"\w[;:]\w|^;|[bcdfghjklmnpqrstvwxz]{4}|[aeiou]{4}|q(?:[^u]|$)|" + "|".join(3 * c for c in "abcdefghijklmnopqrstuvwxyz0123456789_")
EDGE = ".,!?…;:\"“”‘’'«»„()[]（）「」『』*-–—。！？،؟।"

#: Delimiters of table fields, most telling first, and of items on one line.
DELIMITERS = ("\t", "|", ";", ",")
SEPARATORS = (";", "|", ",", " / ", " · ", "•", "، ", "、")
#: A cell of more characters than this is a clause, not a field; items on one line may be a little longer.
CELL_CHARS, ITEM_CHARS, ITEM_WORDS = 24, 30, 4
#: Autocorrelation about the width from which on unmarked lines are items, and the share of common words from which on they are clauses.
ROOM, CLAUSE = 0.03, 0.4
#: The same in scripts without spaces, where common words are found inside and weigh by their characters.
DENSE_CLAUSE = 0.24
#: No text is wrapped narrower than this, so the width of a text of short lines only counts as this.
NARROWEST = 40
#: Characters measured together.
SLICE_CHARS = 1_000_000
#: Blocks of Thai, Kana and Han.
UNSPACED_BLOCKS = ((0x0E00, 0x0E80), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000))


def _kinds_of_chars() -> np.ndarray:
    """Kinds of code points: 0 other, 1 letter or mark, 2 digit, 3 white space, 4 letter of a script without spaces."""
    t = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        t[k] = 3 if c.isspace() else 1 if unicodedata.category(c)[0] in "LM" else 2 if c.isdigit() else 0
    for a, b in UNSPACED_BLOCKS:
        part = t[a:b]
        part[part == 1] = 4
    return t


class CommonWords:
    """The common words, to be looked up by word or, in texts without spaces, found inside."""

    kinds: np.ndarray | None = None

    def __init__(self, words: frozenset[str]):
        if CommonWords.kinds is None:
            CommonWords.kinds = _kinds_of_chars()
        self.words = pa.array(sorted(words), pa.string())
        inside = sorted((w for w in words if not w.isascii() and any(CommonWords.kinds[ord(c)] == 4 for c in w)), key=len, reverse=True)
        self.inside = _re.compile("|".join(map(_re.escape, inside)) or r"(?!)")


def autocorrelation(x: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Of successive values about their mean by document; 0 where there are fewer than four, 1 where all are equal."""
    count = np.bincount(doc, minlength=n_docs)
    mean = np.bincount(doc, x, n_docs) / np.maximum(count, 1)
    d = x - mean[doc]
    near = doc[1:] == doc[:-1]
    cov = np.bincount(doc[1:][near], (d[1:] * d[:-1])[near], n_docs)
    var = np.bincount(doc, d * d, n_docs)
    return np.where(count < 4, 0.0, np.where(var > 1e-9, cov / np.maximum(var, 1e-9), 1.0))


def room_autocorrelation(room: np.ndarray) -> float:
    """Autocorrelation at one line's distance of line lengths about the width of their text: ``room`` is the share of the width each line leaves empty."""
    return float((room[1:] * room[:-1]).mean()) if len(room) > 1 else 0.0


def _find(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _number(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _both(same: np.ndarray) -> np.ndarray:
    """Lines of which a neighbouring pair is marked: ``same[k]`` speaks of lines k and k + 1."""
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


class Lines:
    """The lines that are not blank of some texts, laid end to end, with what each is. ``doc`` is the text's place."""

    def __init__(self, texts: pa.Array, common: CommonWords):
        parts = pc.split_pattern(texts, "\n")
        raw, doc = pc.list_flatten(parts), _number(pc.list_parent_indices(parts)).astype(np.int64)
        bare = pc.utf8_trim_whitespace(raw)
        full = _number(pc.utf8_length(bare)) > 0
        keep = pa.array(full)
        raw, self.text, self.doc = raw.filter(keep), bare.filter(keep), doc[full]
        self.n_docs, self.count = len(texts), len(self.doc)
        self.length = _number(pc.utf8_length(self.text)).astype(np.int64)
        self.indent = _number(pc.subtract(pc.utf8_length(raw), pc.utf8_length(pc.utf8_ltrim_whitespace(raw)))).astype(np.int64)
        self.near = self.doc[1:] == self.doc[:-1]
        words = pc.utf8_split_whitespace(self.text)
        self.words, self.word_line = pc.list_flatten(words), _number(pc.list_parent_indices(words)).astype(np.int64)
        self.n_words = np.bincount(self.word_line, minlength=self.count)
        trimmed = pc.utf8_trim(pc.utf8_lower(self.words), EDGE)
        self.is_word = _number(pc.greater(pc.binary_length(trimmed), 0))
        self.is_common = _number(pc.is_in(trimmed, common.words)) & self.is_word
        self.stop, self.ended = _find(self.text, STOP), _find(self.text, ENDS)
        self.rule = ~_find(self.text, WORDY)
        self.width = np.full(self.n_docs, NARROWEST, np.int64)
        np.maximum.at(self.width, self.doc, self.length)
        self.room = 1 - self.length / self.width[self.doc]

    def counts(self, mark: str) -> np.ndarray:
        """How often a mark stands in each line; for marks beyond ASCII and longer ones first by the last byte of the character that tells them, then exactly where that may do."""
        byte = mark.strip(" ").encode()[-1] if mark.strip(" ") else mark.encode()[-1]
        offsets, data = np.frombuffer(self.text.buffers()[1], np.int32)[self.text.offset : self.text.offset + self.count + 1], np.frombuffer(self.text.buffers()[2] or b"", np.uint8)
        at = np.flatnonzero(data == byte)
        n = np.diff(np.searchsorted(at, offsets))
        if len(mark.encode()) > 1:
            likely = n >= 5
            n = np.zeros(self.count, np.int64)
            if likely.any():
                n[likely] = _number(pc.count_substring(self._pick(likely), mark))
        return n

    def by_line(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_line, of_words, self.count)

    def _pick(self, where: np.ndarray) -> pa.Array:
        return self.text.take(pa.array(np.flatnonzero(where)))

    def _cells(self, where: np.ndarray, delimiter: str, chars: int, words: int | None = None) -> np.ndarray:
        """Share of cells of each of these lines that are short and hold no sentence end; 0 for lines of a single cell."""
        cells = pc.split_pattern(pc.utf8_trim(self._pick(where), "| ") if delimiter == "|" else self._pick(where), delimiter)
        flat, line = pc.utf8_trim_whitespace(pc.list_flatten(cells)), _number(pc.list_parent_indices(cells)).astype(np.int64)
        good = (_number(pc.utf8_length(flat)) <= chars) & ~_find(flat, STOP)
        if words is not None:
            good &= _number(pc.list_value_length(pc.utf8_split_whitespace(flat))) <= words
        n = np.bincount(line, minlength=int(where.sum()))
        return np.where(n > 1, np.bincount(line, good, len(n)) / np.maximum(n, 1), 0.0)

    def aligned(self) -> np.ndarray:
        """Rows of fields: delimiters in like number as on a neighbouring line, or fields that begin where its fields begin."""
        table = np.zeros(self.count, bool)
        for d in DELIMITERS:
            n = self.counts(d)
            hit = _both((n[1:] == n[:-1]) & (n[1:] > 0) & self.near) if n.any() else table
            if hit.any():
                table[np.flatnonzero(hit)[self._cells(hit, d, CELL_CHARS) >= 0.8]] = True
        return table | self._columns() | self._number_rows() | self._ruled() | self._pairs()

    def _columns(self) -> np.ndarray:
        """Lines whose fields, set off by runs of blanks, begin at places where those of a neighbour begin."""
        wide = _find(self.text, r"\s\s")
        if not wide.any():
            return wide
        at = np.flatnonzero(wide)
        codes = np.frombuffer("".join(self._pick(wide).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = self.length[at]
        line = np.repeat(np.arange(len(at)), size)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        blank = CommonWords.kinds[codes] == 3
        begins = np.zeros(len(codes), bool)
        begins[2:] = ~blank[2:] & blank[1:-1] & blank[:-2] & (column[2:] > 1)
        line, column = at[line[begins]], column[begins] + self.indent[at[line[begins]]]
        n = np.bincount(line, minlength=self.count)
        step = int(column.max(initial=0)) + 1
        met = np.isin(line * step + column, (line - 1) * step + column)  # a field that begins above one of the next line
        shared = np.bincount(line[met], minlength=self.count)[:-1]
        least = np.minimum(n[1:], n[:-1])
        same = self.near & (least > 0) & (shared >= np.maximum(1, (2 * least + 2) // 3))
        rows = _both(same) & wide
        if rows.any():
            first = pc.replace_substring_regex(self._pick(rows), r"\s\s.*$", "")
            rows[np.flatnonzero(rows)[_find(first, STOP)]] = False
        return rows

    def _number_rows(self) -> np.ndarray:
        """Lines of two or more blank-separated fields, as many as a neighbour's, half of them numbers or identifiers."""
        like = (self.n_words[1:] == self.n_words[:-1]) & (self.n_words[1:] >= 2) & self.near
        asked = np.flatnonzero(_both(like)[self.word_line])
        numeric = np.bincount(self.word_line[asked], _find(self.words.take(pa.array(asked)), NUMERIC), self.count)
        good = 2 * numeric >= self.n_words
        return _both(good[1:] & good[:-1] & like)

    def _ruled(self) -> np.ndarray:
        """Lines after a rule ("+----+") with as many blank-separated fields as most of them, in texts of two rules or more."""
        out = np.zeros(self.count, bool)
        rules = np.bincount(self.doc[self.rule], minlength=self.n_docs)
        for d in np.flatnonzero((rules >= 2) & (np.bincount(self.doc, minlength=self.n_docs) > rules)):
            lo, hi = np.searchsorted(self.doc, [d, d + 1])
            n, rule = self.n_words[lo:hi], self.rule[lo:hi]
            inside = ~rule & (np.arange(hi - lo) > np.flatnonzero(rule)[0]) & (n >= 2) & ~self.stop[lo:hi]
            if inside.any():
                rows = inside & (n == Counter(n[inside].tolist()).most_common(1)[0][0])
                out[lo:hi] |= rows & (rows.sum() >= 2)
        return out

    def _pairs(self) -> np.ndarray:
        """Name-value lines, two or more in a row: the value is of any length, but no clause (few common words, no sentence end)."""
        pair = _find(self.text, "[:=]") & ~self.stop
        if not pair.any():
            return pair
        pair[pair] = _find(self._pick(pair), KEY_VALUE)
        pair &= (self.by_line(self.is_common) < 0.25 * self.n_words) & (self.marker() == 0)
        return _both(pair[1:] & pair[:-1] & self.near)

    def marker(self) -> np.ndarray:
        """0 for none, else the kind of mark that a line begins with."""
        if not hasattr(self, "_marker"):
            self._marker = np.zeros(self.count, np.int64)
            for k, pattern in enumerate(MARKERS, 1):
                hit = _find(self.text, pattern) & (self._marker == 0)
                self._marker[hit & ~self.stop if k == len(MARKERS) else hit] = k
            at = _find(self.text, NUMBERED)
            if at.any():  # bare numbers are marks where each is one above the number before
                n = np.full(self.count, -9, np.int64)
                n[at] = pc.struct_field(pc.extract_regex(self._pick(at), NUMBERED), "n").cast(pa.int64()).to_numpy(zero_copy_only=False)
                up = _both((n[1:] == n[:-1] + 1) & (n[:-1] >= 0) & self.near)
                self._marker[up & (self._marker == 0)] = len(MARKERS) + 1
        return self._marker

    def series(self) -> np.ndarray:
        """Lines that are many short items between separators."""
        out = np.zeros(self.count, bool)
        for s in SEPARATORS:
            many = (self.counts(s) >= 5) & ~out
            if many.any():
                at = np.flatnonzero(many)
                good = self._cells(many, s, ITEM_CHARS, ITEM_WORDS) >= 0.9
                out[at[good]] = ~_find(pc.utf8_slice_codeunits(self._pick(many), 0, -2), STOP)[good]
        return out

    def indentation_period(self) -> np.ndarray:
        """Lines that come back by indentation: same mark and depth as the line one period before or after, where the period is the commonest distance
        between successive such lines of the text, clauses left out; and lines without mark that hang deeper on a marked one.

        A depth of 0 without mark is no sign of anything.
        """
        marker = self.marker()
        told = (marker > 0) | (self.indent > 0)
        out = np.zeros(self.count, bool)
        if not told.any():
            return out
        at = np.flatnonzero(told)
        profile = self.doc[at] * 1_000_003 + marker[at] * 1_009 + np.minimum(self.indent[at], 1_000)
        order = np.argsort(profile, kind="stable")
        again = profile[order][1:] == profile[order][:-1]
        gap = (at[order][1:] - at[order][:-1])[again]
        left, right = at[order][:-1][again], at[order][1:][again]
        if len(gap):
            step = int(gap.max()) + 1
            keys, n = np.unique(self.doc[left] * step + gap, return_counts=True)
            best = np.lexsort((keys, -n, keys // step))
            first = best[np.r_[True, (keys // step)[best][1:] != (keys // step)[best][:-1]]]
            period = np.zeros(self.n_docs, np.int64)
            period[keys[first] // step] = keys[first] % step
            on = gap == period[self.doc[left]]
            out[left[on]] = out[right[on]] = True
        place = np.arange(self.count)
        last = np.maximum.accumulate(np.where(marker > 0, place, -1))
        flush = np.maximum.accumulate(np.where((marker == 0) & (self.indent == 0), place, -1))
        hangs = (marker == 0) & (last > flush) & (last >= 0) & (self.doc[last] == self.doc) & (self.indent > self.indent[last])
        return (out & ~self.stop & ((marker > 0) | ~self.ended)) | hangs

    def kinds(self, unspaced: np.ndarray, common_words: CommonWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which lines are rows of a table, items of a list, and prose; ``unspaced`` tells the texts in scripts without spaces."""
        table = self.aligned()
        marker = self.marker()
        leader = _find(self.text, LEADER)
        periodic = self.indentation_period()
        touches = np.zeros(self.count, bool)
        touches[1:] |= table[:-1] & self.near
        touches[:-1] |= table[1:] & self.near
        item = (marker > 0) | leader | (self.series() & ~table) | (periodic & ~table)
        table = (table | (self.rule & touches)) & ~item
        # lines without mark: what they leave empty line after line tells items from wrapped prose, common words tell items from clauses
        loose = (~self.stop & ~self.ended & ~table & ~self.rule) | item
        edge = np.flatnonzero(np.diff(np.r_[False, loose, False].astype(np.int8)) | np.r_[False, ~self.near, False] if self.count else [])
        common = np.cumsum(np.r_[0.0, self.by_line(self.is_common)])
        words = np.cumsum(np.r_[0.0, self.by_line(self.is_word)])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if len(edge) else ():
            if not loose[lo] or hi - lo < 4:
                continue
            if room_autocorrelation(self.room[lo:hi]) < ROOM:
                continue
            if unspaced[self.doc[lo]]:
                run = "".join(self.text[lo:hi].to_pylist())
                item[lo:hi] |= sum(map(len, common_words.inside.findall(run))) < DENSE_CLAUSE * len(run)
            else:
                item[lo:hi] |= common[hi] - common[lo] < CLAUSE * max(1.0, words[hi] - words[lo])
        table &= ~item
        return table, item, ~table & ~item & ~self.rule


def mash_share(words: pa.Array, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each document's Latin words that nobody could read: marks inside, no vowel, or long consonant runs; 0 under five such words."""
    latin = _find(words, "^[\\x00-\\x7F]+$") & _find(words, "[a-zA-Z]{2}")
    low, of = pc.utf8_lower(words.filter(pa.array(latin))), doc[latin]
    odd = _find(low, MASH) | (_number(pc.greater(pc.utf8_length(low), 3)) & ~_find(low, VOWEL))
    n = np.bincount(of, minlength=n_docs)
    return np.where(n >= 5, np.bincount(of, odd, n_docs) / np.maximum(n, 1), 0.0)


def repeated_share(unit: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each document's units that equal the unit one period before, where the period is the commonest distance between successive equal pairs of units.

    ``unit`` are codes laid end to end, ``doc`` their documents. A text of one sequence repeated k times has a share of 1 - 1/k, whatever stands before it
    and however long the sequence is.
    """
    out = np.zeros(n_docs)
    if len(unit) < 3:
        return out
    size = np.bincount(doc, minlength=n_docs)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    left, right, own = (v.astype(np.uint64) for v in (unit[pair], unit[pair + 1], doc[pair]))
    key = ((left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xBF58476D1CE4E5B9) + own) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    gap, of = (pair[order][1:] - pair[order][:-1])[again], doc[pair[order]][1:][again]
    if not len(gap):
        return out
    step = int(gap.max()) + 1
    keys, n = np.unique(of * step + gap, return_counts=True)
    owner = keys // step
    best = np.lexsort((keys, -n, owner))
    first = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
    period = np.zeros(n_docs, np.int64)
    period[owner[first]] = keys[first] % step
    at = np.flatnonzero(period[doc] > 0)
    back = at - period[doc[at]]
    ok = (back >= 0) & (doc[back] == doc[at])
    ok &= unit[at] == unit[back]
    return np.bincount(doc[at][ok], minlength=n_docs) / np.maximum(size, 1)


def _distinct_share(values: pa.Array, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of a document's values that repeat one of its own before."""
    code = _number(values.dictionary_encode().indices).astype(np.int64)
    n = np.bincount(doc, minlength=n_docs)
    distinct = np.bincount(np.unique(doc * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1), minlength=n_docs)
    return np.where(n > 0, 1.0 - distinct / np.maximum(n, 1), 0.0)


def _share_of(pattern: _re.Pattern, text: str) -> float:
    return sum(len(m.group()) for m in pattern.finditer(text)) / len(text)


def measure(texts: list[str], common: CommonWords) -> dict[str, np.ndarray]:
    """The measures of some texts, none of them blank, by name."""
    n, array = len(texts), pa.array(texts, pa.string())
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n_chars = np.array([len(t) for t in texts], np.int64)
    of_char = np.repeat(np.arange(n), n_chars)
    kinds = np.bincount(of_char * 5 + CommonWords.kinds[codes], minlength=5 * n).reshape(n, 5)
    other, letters, digits, blank, dense = kinds.T
    visible = np.maximum(1, n_chars - blank)
    unspaced = dense > 0.3 * np.maximum(1, letters + dense)

    x = Lines(array, common)
    word_doc = x.doc[x.word_line]
    n_words = np.bincount(word_doc, minlength=n)
    known = np.bincount(word_doc[x.is_common], minlength=n) / np.maximum(1, np.bincount(word_doc[x.is_word], minlength=n))
    for k in np.flatnonzero(unspaced):
        known[k] = sum(map(len, common.inside.findall(texts[k]))) / visible[k]
    table, item, plain = x.kinds(unspaced, common)
    total = np.maximum(np.bincount(x.doc, x.length, n), 1)
    n_lines = np.bincount(x.doc, minlength=n)
    weigh = lambda of: np.bincount(x.doc[of], x.length[of], n) / total
    share = lambda of: np.bincount(x.doc[of], minlength=n) / np.maximum(n_lines, 1)

    spaced = ~unspaced[word_doc]
    letter = unspaced[of_char] & np.isin(CommonWords.kinds[codes], (1, 2, 4))
    unit = np.concatenate([_number(x.words.dictionary_encode().indices)[spaced], codes[letter].astype(np.int64) + (1 << 32)])
    of_unit = np.concatenate([word_doc[spaced], of_char[letter]])
    order = np.argsort(of_unit, kind="stable")
    parts = pc.split_pattern_regex(array, SENTENCE_GAPS)
    sentence, of = pc.utf8_trim_whitespace(pc.list_flatten(parts)), _number(pc.list_parent_indices(parts)).astype(np.int64)
    long = _number(pc.utf8_length(sentence)) > 12
    sentences = np.bincount(of[long], minlength=n)

    strange = known < 0.2  # measures of texts that read like no language
    tags = _find(array, "[<&]")
    pieces = _find(array, "<0x|Ġ|▁")
    damaged = _find(array, DAMAGE_SIGNS)
    single = {c: np.zeros(n) for c in ("tag_share", "piece_share", "solid_share", "spaced_letter_share", "hex_share", "damage_share")}
    of_strange = strange[word_doc] & ~unspaced[word_doc]
    mash = mash_share(x.words.filter(pa.array(of_strange)), word_doc[of_strange], n)
    word_chars = _number(pc.utf8_length(x.words)).astype(np.int64)
    letters_alone = np.bincount(word_doc, word_chars == 1, n) > 0.2 * n_words
    codes_alone = np.bincount(word_doc, (word_chars == 2) | (word_chars == 3), n) > 0.3 * n_words
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, word_doc, word_chars)
    for k in np.flatnonzero((strange & (codes_alone | (longest >= 12))) | tags | pieces | damaged | (letters_alone & ~unspaced)):
        t = texts[k]
        words = max(1, int(n_words[k]))
        single["tag_share"][k] = _share_of(TAG, t) if tags[k] else 0.0
        single["piece_share"][k] = _share_of(PIECE, t) if pieces[k] else 0.0
        single["damage_share"][k] = len(DAMAGE.findall(t)) / words if damaged[k] else 0.0
        if letters_alone[k] and not unspaced[k]:
            single["spaced_letter_share"][k] = _share_of(SPACED, t)
        if strange[k] and longest[k] >= 12:
            single["solid_share"][k] = _share_of(SOLID, t)
        if strange[k] and codes_alone[k]:
            single["hex_share"][k] = len(HEX.findall(t)) / words
    pairs = np.bincount(x.doc[1:][x.near], minlength=n)
    return {
        "n_chars": n_chars, "n_lines": n_lines, "n_words": n_words, "mean_word_chars": visible / np.maximum(1, n_words),
        "symbol_share": other / visible, "digit_share": digits / visible, "common_word_share": known, "ended_line_share": share(x.ended),
        "marker_line_share": share(x.marker() > 0), "mean_line_chars": total / np.maximum(n_lines, 1),
        "line_length_autocorrelation": autocorrelation(x.length.astype(float), x.doc, n),
        "room_autocorrelation": np.bincount(x.doc[1:][x.near], (x.room[1:] * x.room[:-1])[x.near], n) / np.maximum(pairs, 1),
        "periodic_indent_share": share(x.indentation_period()), "table_share": weigh(table), "list_share": weigh(item), "prose_share": weigh(plain),
        "rule_share": weigh(x.rule & ~table), **single,
        "line_repeat_share": _distinct_share(x.text, x.doc, n), "sentence_repeat_share": np.where(sentences > 3, _distinct_share(sentence.filter(pa.array(long)), of[long], n), 0.0),
        "repeated_share": repeated_share(unit[order], of_unit[order], n), "mash_share": mash,
    }


def kinds(s: dict[str, np.ndarray]) -> np.ndarray:
    """prose, list, table or junk for each text, from the measures."""
    t, i, p = s["table_share"], s["list_share"], s["prose_share"]
    junk = (s["tag_share"] > 0.35) | (s["piece_share"] > 0.35) | (s["solid_share"] > 0.5) | ((s["rule_share"] > 0.5) & (t + i < 0.3))
    junk |= (s["n_words"] >= 8) & ((s["hex_share"] > 0.6) | (s["spaced_letter_share"] > 0.4))
    junk |= (s["damage_share"] > 0.06) | ((s["mash_share"] > 0.35) & (t < 0.5))
    # three fifths repeat what stands one period before: a sequence that comes three times or more
    junk |= (s["n_words"] >= 8) & (s["repeated_share"] >= 0.6) & (t < 0.5)
    junk |= ((s["n_lines"] >= 4) & (s["line_repeat_share"] > 0.6) & (t < 0.5)) | (s["sentence_repeat_share"] > 0.6)
    junk |= (s["symbol_share"] > 0.6) & (t + i < 0.5)
    laid_out = ~junk & (t + i > p)
    # words without any function word, sentence end or line structure mean nothing in the languages known
    junk |= ~laid_out & (s["common_word_share"] < 0.03) & (s["n_words"] >= 8) & (s["ended_line_share"] < 0.2) & (p > 0.5)
    return np.where(junk, "junk", np.where(laid_out, np.where(t >= i, "table", "list"), "prose"))


COLUMNS = (
    "n_chars n_lines n_words mean_word_chars symbol_share digit_share common_word_share ended_line_share marker_line_share mean_line_chars "
    "line_length_autocorrelation room_autocorrelation periodic_indent_share table_share list_share prose_share rule_share tag_share piece_share solid_share "
    "spaced_letter_share hex_share damage_share line_repeat_share sentence_repeat_share repeated_share mash_share"
).split()
WHOLE = frozenset({"n_chars", "n_lines", "n_words"})


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Successive texts of together about SLICE_CHARS characters; a longer text comes alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def text_quality(docs: DataFrame, common_words: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``(ident, <measures>, kind)`` for every row; ``common_words`` (word) is a small fixed table.

    Null and blank texts have null measures and the kind ``blank``. Whole texts are measured, however long.
    """
    words = frozenset(r.word.lower() for r in common_words.select("word").dropna().distinct().collect())
    id_type = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = CommonWords(words)
        for b in batches:
            texts = [t if t is not None and t.strip() else None for t in b.column(1).to_pylist()]
            there = np.array([t is not None for t in texts], bool)
            done = [measure(part, common) for part in _slices([t for t in texts if t is not None])]
            at = pa.array(np.where(there, np.cumsum(there) - 1, -1), mask=~there)
            column = lambda c: pa.array(np.concatenate([m[c] for m in done]) if done else np.zeros(0), pa.int64() if c in WHOLE else pa.float64())  # noqa: B023, E731
            kind = pa.array(np.concatenate([kinds(m) for m in done]).tolist() if done else [], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(column(c).take(at) for c in COLUMNS), pc.fill_null(kind.take(at), "blank")], names=[ident, *COLUMNS, "kind"])

    schema = ", ".join([f"`{ident}` {id_type}", *(f"{c} {'bigint' if c in WHOLE else 'double'}" for c in COLUMNS), "kind string"])
    return docs.select(ident, F.col(text).alias("_text")).mapInArrow(run, schema)
