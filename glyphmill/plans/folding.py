"""Terms and clean phrases in SQL: compatibility forms by a table made from the Unicode data, composed by ``nfc_normalize``."""

from __future__ import annotations

import sys
import unicodedata

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def compatibility_rows() -> str:
    """VALUES of every character whose compatibility form is not its canonical one, with that form."""
    forms = ((c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(c)}, {quoted(f)})" for c, f in forms if f != unicodedata.normalize("NFD", c))


def folded(name: str, source: str, column: str, start_mark: bool = False) -> str:
    """CTEs: ``name`` (raw, folded) for each distinct value of ``column`` in ``source``: without Cf characters, in NFKC, lower-cased; trimmed as a term or, without ``start_mark``, spaced as a clean phrase."""
    bare = f"regexp_replace({column}, '^[Ġ▁]', '')" if start_mark else column
    low = "lower(nfc_normalize(coalesce(k, '')))"
    if start_mark:
        text = rf"regexp_replace({low}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
        text = rf"CASE WHEN regexp_matches({text}, '[\p{{L}}\p{{N}}]') THEN {text} END"
    else:
        text = rf"trim(regexp_replace({low}, '{_SPACE}+', ' ', 'g'))"
    return rf"""{name}_raw AS (SELECT DISTINCT {column} AS raw, regexp_replace({bare}, '\p{{Cf}}', '', 'g') AS s FROM {source} WHERE {column} IS NOT NULL),
    {name}_chars AS (SELECT raw, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM {name}_raw),
    {name}_forms AS (SELECT raw, string_agg(coalesce(f, c), '' ORDER BY i) AS k FROM {name}_chars LEFT JOIN compat USING (c) GROUP BY raw),
    {name} AS (SELECT raw, {text} AS folded FROM {name}_raw LEFT JOIN {name}_forms USING (raw))"""


#: First CTE of every statement that folds.
COMPAT = f"compat(c, f) AS (VALUES {compatibility_rows()})"

#: CTEs: ``kd`` (doc_id, author, tokens), one row a document, ``kt`` (doc_id, token) and ``terms`` (raw, folded).
TERMS = f"""{COMPAT}, kd AS (SELECT doc_id, any_value(author) AS author, any_value(tokens) AS tokens FROM known_texts GROUP BY doc_id),
    kt AS (SELECT doc_id, author, unnest(tokens) AS token FROM kd), {folded('terms', 'kt', 'token', start_mark=True)}"""
