"""Scalar and array functions on texts and tokens, as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that only pad sentences.
PAD_START, PAD_END, UNKNOWN = "<s>", "</s>", "<unk>"
#: Fixed value: the least probability, by which zeros are replaced.
FLOOR = 2.2250738585072014e-308
#: What tokenizers show for a blank and a line feed, and marks of a word's start.
SPECIAL_MARKS, BOUNDARY_MARKS = ("Ġ", "Ċ"), ("Ġ", "▁")
#: ASCII punctuation as a class of characters.
PUNCTUATION_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def words(text: Column) -> Column:
    """Lower-cased word tokens (runs of letters, digits and underscores of any script)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "capt dr mr mrs prof rev sr jr e.g i.e etc et al a.m p.m vs cf viz ca vol pp fig".replace("et al", "et_al").split()
#: Pattern of an abbreviation with its full stop, after a place where a word may begin.
ABBREVIATION = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.").replace("_", " ") for a in ABBREVIATIONS) + r")\."
#: What stands for a sentence mark that ends no sentence while a text is split.
_MARKS, _STAND_INS = ".!?\n", "\u0002\u0003\u0004\u0005"
#: Words that stand for a backslash and for a broken reference in prepared texts.
PLACEHOLDERS = {"\\": "__BACKSLASH_PLACEHOLDER__", "(??)": "__REF_ERROR__"}


def split_sentences(text: Column, entities: Column | None = None) -> Column:
    """Parts between sentence marks followed by white space, or line ends; blank parts removed.

    The full stops of known abbreviations end nothing, nor do marks inside the named ``entities`` (array of strings), the longest first.
    """
    if entities is not None:
        longest = F.array_sort(F.filter(F.array_distinct(entities), lambda e: e.isNotNull() & (e != "")), lambda x, y: F.length(y) - F.length(x))
        text = F.aggregate(longest, text, lambda t, e: F.replace(t, e, F.translate(e, _MARKS, _STAND_INS)))
    safe = F.regexp_replace(text, ABBREVIATION, "$1$2\u0002")
    parts = F.filter(F.split(safe, r"[.!?]\s+|\n", -1), lambda s: s.rlike(r"[^\s\p{Z}]"))
    return F.transform(parts, lambda s: F.translate(s, _STAND_INS, _MARKS))


def with_placeholders(text: Column) -> Column:
    """Backslashes and broken references replaced by words, before a text goes to a tool that cannot take them."""
    return functools.reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), PLACEHOLDERS.items(), text)


def without_placeholders(text: Column) -> Column:
    return functools.reduce(lambda t, kv: F.replace(t, F.lit(kv[1]), F.lit(kv[0])), PLACEHOLDERS.items(), text)


def temp_doc_id(raw: Column) -> Column:
    """First bracketed group with non-word characters as single underscores, lower-cased; null without brackets."""
    inner = F.regexp_extract(raw, r"\[(.*?)\]", 1)
    return F.when(raw.rlike(r"\[.*?\]"), F.lower(F.regexp_replace(F.regexp_replace(inner, r"[^\p{L}\p{N}_]", "_"), "_{2,}", "_")))


def without_control_chars(text: Column) -> Column:
    """Without the control characters that workbooks refuse."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def windows_of(tokens: Column, n: int) -> Column:
    """All slices of length n; empty where there are fewer tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))).otherwise(
        F.array().cast("array<array<string>>")
    )


def padded(tokens: Column, order: int) -> Column:
    """order - 1 start marks, the tokens, one end mark."""
    return F.concat(F.array_repeat(F.lit(PAD_START), order - 1), tokens, F.array(F.lit(PAD_END)))


def joined(tokens: Column) -> Column:
    """One string for a token tuple, with a separator that no token contains."""
    return F.array_join(tokens, "\u0001")


def occurrence_prefixes(text: Column, phrase: Column) -> Column:
    """Lower-cased text before each non-overlapping occurrence of a phrase; the whole text where it does not occur."""
    t, p = F.lower(text), F.lower(phrase)
    parts = F.split(t, F.concat(F.lit("\\Q"), p, F.lit("\\E")), -1)
    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.call_function("array_join", F.slice(parts, F.lit(1), i), p))
    return F.when((F.size(parts) > 1) & (p != ""), found).otherwise(F.array(t))


def find_spans(tokens: Column, phrase: Column) -> Column:
    """Zero-based starts of every place where the phrase's tokens stand; overlapping places count."""
    n = F.size(phrase)
    return F.when(
        (n > 0) & (F.size(tokens) >= n),
        F.transform(F.filter(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n) == phrase), lambda i: i - 1),
    ).otherwise(F.array().cast("array<int>"))


def masked_single(tokens: Column, start: Column, length: Column, mask: str) -> Column:
    """The span replaced by one mask."""
    return F.concat(F.slice(tokens, F.lit(1), start), F.array(F.lit(mask)), F.slice(tokens, start + length + 1, F.greatest(F.size(tokens) - start - length, F.lit(0))))


def masked_each(tokens: Column, start: Column, length: Column, mask: str) -> Column:
    """Every token of the span replaced by a mask."""
    return F.concat(F.slice(tokens, F.lit(1), start), F.array_repeat(F.lit(mask), length), F.slice(tokens, start + length + 1, F.greatest(F.size(tokens) - start - length, F.lit(0))))


def is_punctuation(token: Column, specials: tuple[str, ...] = SPECIAL_MARKS) -> Column:
    """Something is left of the token without special marks, and all of it is ASCII punctuation."""
    bare = functools.reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), specials, token)
    return bare.rlike(f"^{PUNCTUATION_CLASS}+$")


def is_special_only(token: Column, specials: tuple[str, ...] = SPECIAL_MARKS) -> Column:
    bare = functools.reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), specials, token)
    return bare.rlike(f"^{PUNCTUATION_CLASS}*$")


def keeps_ngram(gram: Column, specials: tuple[str, ...] = SPECIAL_MARKS, boundaries: tuple[str, ...] = BOUNDARY_MARKS, word_mode: bool = False) -> Column:
    """Whether an n-gram holds more than one word: length 2 or more, two word tokens, and (unless in word mode) a word start after
    the first token; a pair with exactly one word is out."""
    is_word = lambda t: ~is_punctuation(t, specials) & ~is_special_only(t, specials)
    n_words = F.size(F.filter(gram, is_word))
    later = F.slice(gram, 2, F.greatest(F.size(gram) - 1, F.lit(0)))
    starts = F.exists(later, lambda t: functools.reduce(operator.or_, [t.startswith(b) for b in boundaries]))
    ok = (F.size(gram) >= 2) & (n_words > 1)
    return ok if word_mode else ok & starts


def perplexity(log_probs: Column) -> Column:
    """exp of the negative mean of natural-log probabilities; null for an empty array."""
    return F.when(F.size(log_probs) > 0, F.exp(-F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / F.size(log_probs)))


def token_differences(log_probs: Column, medians: Column) -> Column:
    """Structure of the per-token and summed measures of a scored sentence: differences to the median, their absolute values and means."""
    diff = F.zip_with(log_probs, medians, lambda a, b: a - b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    n = F.size(log_probs)
    mean = lambda x: F.when(n > 0, total(x) / n)
    absolute = F.transform(diff, lambda x: F.abs(x))
    return F.struct(
        diff.alias("differences"), absolute.alias("abs_differences"), n.alias("num_tokens"), total(log_probs).alias("sum_log_prob"),
        mean(log_probs).alias("avg_log_prob"), mean(diff).alias("mean_diff"), mean(absolute).alias("mean_abs_diff"), perplexity(log_probs).alias("perplexity"),
    )


def json_object(text: Column) -> Column:
    """From the first brace to the last one, if that parses; else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def parse_paraphrases(responses: Column, phrase: Column) -> Column:
    """Paraphrases of all answers but the first: lower-cased, without the phrase itself, each once in order of appearance."""
    rest = F.slice(responses, 2, F.greatest(F.size(responses) - 1, F.lit(0)))
    lists = F.transform(rest, lambda r: F.coalesce(F.from_json(json_object(r), "paraphrases array<string>").getField("paraphrases"), F.array().cast("array<string>")))
    low = F.transform(F.flatten(lists), lambda s: F.lower(s))
    return F.array_distinct(F.filter(low, lambda s: s.isNotNull() & (s != F.lower(phrase))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; raises for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.raise_error(F.lit("cosine similarity of a zero vector")).cast("double"))


#: Symbols of open word classes, and clitics that are kept.
POS_SYMBOLS = {"NOUN": "#", "PROPN": "§", "VERB": "Ø", "ADJ": "@", "ADV": "©", "NUM": "µ", "SYM": "$", "X": "¥"}
CLITICS = ("'m", "'d", "'s", "'re", "'ve", "'ll", "n't", "'t")


def masked_pos(tokens: Column, spaces: Column, tags: Column, keep: tuple[str, ...] = (), symbols: dict[str, str] = POS_SYMBOLS, clitics: tuple[str, ...] = CLITICS) -> Column:
    """Content words replaced by the symbol of their tag; ``keep`` (function words, without regard to case), clitics, other tags and the white space after each token stay.

    ``tags`` are universal part-of-speech tags, as any tagger gives them. Numbers are masked only when they are all digits or a single Roman letter.
    """
    table = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    rows = F.arrays_zip(tokens.alias("t"), spaces.alias("s"), tags.alias("p"))

    def one(r: Column) -> Column:
        word, tag = r["t"], r["p"]
        numeric = (tag != "NUM") | word.rlike(r"^\p{Nd}+$") | word.rlike(r"^[IVXLCDMivxlcdm]$")
        kept = F.lower(word).isin(list(keep)) | word.isin(list(clitics)) | ~numeric
        masked = F.when(kept, word).otherwise(F.coalesce(F.try_element_at(table, tag), word))
        return F.concat(masked, F.when(r["s"], F.lit(" ")).otherwise(F.lit("")))

    return F.array_join(F.transform(rows, one), "")


def token_repr(tokens: Column) -> Column:
    """A token tuple as it is written in workbooks: quoted, in brackets."""
    quoted = lambda t: F.concat(F.lit("'"), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.concat(F.lit("("), F.array_join(F.transform(tokens, quoted), ", "), F.lit(")"))


def user_prompt(phrase: Column, raw: Column, context: Column) -> Column:
    """The request for paraphrases of a phrase in its text, with the phrase as its tokens are written."""
    part = lambda name, x, q: F.concat(F.lit(f"<{name}>\n{q}"), x, F.lit(f"{q}\n</{name}>\n"))
    return F.concat(F.lit("\n"), part("DOC", context, ""), part("RAW NGRAM", raw, '"'), part("NGRAM", phrase, '"'))


def fill_in_prompt(before: Column, after: Column, marks: tuple[str, str, str] = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")) -> Column:
    """Text before and after a gap in the order in which a fill-in-the-middle model takes them."""
    return F.concat(F.lit(marks[0]), before, F.lit(marks[1]), after, F.lit(marks[2]))


def hashed_vector(tokens: Column, dims: int = 64) -> Column:
    """Counts of an array's tokens by md5, as an array of doubles: stands where a sentence-embedding model would. Null arrays count as empty ones."""
    import hashlib

    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def count(s):  # noqa: ANN001, ANN202
        place: dict[str, int] = {}

        def of(w: str) -> int:
            if w not in place:
                if len(place) > 200_000:
                    place.clear()
                place[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dims
            return place[w]

        return s.map(lambda t: np.bincount([of(w) for w in (t if t is not None else ()) if w is not None], minlength=dims).astype(float))

    return count(tokens)


def changed_tokens(before: Column, after: Column) -> Column:
    """Of two token arrays the places at which they differ, with both tokens: ``array<struct<at, was, now>>``. A place that only one has differs."""
    rows = F.arrays_zip(before.alias("was"), after.alias("now"))
    placed = F.transform(rows, lambda r, k: F.struct(k.alias("at"), r["was"].alias("was"), r["now"].alias("now")))
    return F.filter(placed, lambda r: ~r["was"].eqNullSafe(r["now"]))


def leading_mark(token: Column) -> Column:
    """The first character of a token if it is no letter, mark, digit or ASCII character: what a tokenizer shows for a blank or another special character; else null."""
    first = F.substring(token, 1, 1)
    return F.when(first.rlike(r"[^\p{L}\p{M}\p{N}\x00-\x7F]") | first.isin("Ġ", "Ċ", "ĉ", "Č", "▁"), first)
