"""Normal forms of terms, phrases and keys.

NFKC and the Unicode category Cf have no JVM-side function in Spark, so the folding runs in Arrow batches: each batch is
dictionary-encoded first and Python sees every distinct string of a batch once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The word-start marks that tokenizers put before a token.
WORD_START_MARKS = ("Ġ", "▁")

#: Distinct strings remembered by one Python worker before its memory is cleared.
CACHE_ENTRIES = 200_000


def _without_format_chars(s: str) -> str:
    return "".join(c for c in s if unicodedata.category(c) != "Cf")


def clean_phrase(s: str | None) -> str | None:
    """Without Cf characters, in NFKC, lower-cased, each run of white space one blank, trimmed."""
    if s is None:
        return None
    if not s.isascii():
        s = unicodedata.normalize("NFKC", _without_format_chars(s))
    return " ".join(s.lower().split())


def clean_term(s: str | None) -> str | None:
    """A token as a term: one word-start mark and Cf characters removed, NFKC, lower-cased, trimmed; None without letter or digit."""
    if not s:
        return None
    if s[0] in WORD_START_MARKS:
        s = s[1:]
    if not s.isascii():
        s = unicodedata.normalize("NFKC", _without_format_chars(s))
    s = s.lower().strip()
    return s if any(c.isalnum() for c in s) else None


class Folder:
    """Applies a string function to Arrow string arrays, once per distinct value, with a bounded memory."""

    def __init__(self, function: Callable[[str], str | None], entries: int = CACHE_ENTRIES):
        self.function, self.entries, self.known = function, entries, {}

    def one(self, s: str) -> str | None:
        try:
            return self.known[s]
        except KeyError:
            if len(self.known) >= self.entries:
                self.known.clear()
            return self.known.setdefault(s, self.function(s))

    def encoded(self, values: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Code of each value's folded form (-1: none) and the folded forms by code."""
        d = values.dictionary_encode()
        codes: dict[str, int] = {}
        to = np.fromiter(
            (-1 if (f := self.one(u)) is None else codes.setdefault(f, len(codes)) for u in d.dictionary.to_pylist()),
            np.int64, len(d.dictionary),
        )
        at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.where(at < 0, -1, to[np.maximum(at, 0)] if len(to) else -1)
        return out, list(codes)


@F.pandas_udf(StringType())
def _clean_phrase_udf(s):  # noqa: ANN001
    return s.map(clean_phrase, na_action="ignore").astype(object)


def clean_phrase_col(c: Column) -> Column:
    """Clean phrase; ASCII strings stay in the JVM and only the others are sent to Python."""
    odd = F.octet_length(c) != F.length(c)
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s\x0B\x1C-\x1F]+", " "))
    return F.when(odd, _clean_phrase_udf(F.when(odd, c))).otherwise(plain)


@F.pandas_udf(StringType())
def _clean_term_udf(s):  # noqa: ANN001
    return s.map(clean_term, na_action="ignore").astype(object)


def clean_term_col(c: Column) -> Column:
    """Term of a raw token (null where it is none); meant for tokens that are already distinct."""
    return _clean_term_udf(c)


def number_in(c: Column) -> Column:
    """The first run of digits of a string as bigint; null without digits or beyond bigint."""
    return F.regexp_extract(c, r"[0-9]+", 0).try_cast("bigint")


def clean_key(c: Column) -> Column:
    """Lower-cased, without surrounding white space of any kind; null where nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x0B\x1C-\x1F\x85]+|[\s\p{Z}\x0B\x1C-\x1F\x85]+$", ""))
    return F.when(bare != "", bare)


def doc_terms(df: DataFrame, id_col: str, tokens_col: str, lengths: bool = False) -> DataFrame:
    """``(id_col, term, tf)``: one row for each term of each row, counted inside the row before anything is shuffled.

    With ``lengths`` also ``length``, the terms of the row counted with repetition, and ``first``, 1 on one of its rows and 0 on the others, so that its sum counts rows.
    Null ids are kept as null; null or empty arrays and tokens that are no terms give no row. Other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(clean_term)
        for b in batches:
            lists = b.column(1)
            codes, terms = folder.encoded(pc.list_flatten(lists))
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = codes >= 0
            keys, counts = np.unique(rows[keep] * max(1, len(terms)) + codes[keep], return_counts=True)
            at, code = np.divmod(keys, max(1, len(terms)))
            more = [np.bincount(rows[keep], minlength=b.num_rows)[at], np.r_[True, at[1:] != at[:-1]][: len(at)].astype(np.int64)] if lengths else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(terms, pa.string()).take(pa.array(code)), pa.array(counts.astype(np.int64)), *(pa.array(x.astype(np.int64)) for x in more)],
                names=[id_col, "term", "tf", "length", "first"][: 5 if lengths else 3],
            )

    return df.select(id_col, tokens_col).mapInArrow(count, f"`{id_col}` {id_type}, term string, tf bigint" + (", length bigint, first bigint" if lengths else ""))
