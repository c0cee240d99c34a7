"""Queries p5: counts and totals per author and per term, with a few keys holding most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import hotkeys as H
from glyphmill.plans.folding import TERMS
from glyphmill.session import table


def p5_found(spark, d):  # noqa: ANN001, ANN201
    return H.heavy_keys(table(spark, d, "known_texts").select("doc_id", "author", "tokens", "num_tokens"))


def p5_author_totals(spark, d):  # noqa: ANN001, ANN201
    return H.author_totals(table(spark, d, "known_texts"))


def p5_term_totals(spark, d):  # noqa: ANN001, ANN201
    return H.term_totals(table(spark, d, "known_texts")).withColumn("total", F.col("total").cast("bigint"))


QUERIES = {"p5_found": p5_found, "p5_author_totals": p5_author_totals, "p5_term_totals": p5_term_totals}

_AUTHORS = r"""d AS (SELECT doc_id, any_value(author) AS author, any_value(num_tokens) AS n FROM known_texts GROUP BY doc_id),
    k AS (SELECT lower(regexp_replace(author, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key_text, n FROM d)"""
_TOTALS = "tt AS (SELECT folded AS key_text, count(*) AS total FROM kt JOIN terms ON token = raw WHERE folded IS NOT NULL GROUP BY folded)"
SQL = {
    "p5_author_totals": f"WITH {_AUTHORS} SELECT key_text, count(*) AS records, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM k WHERE key_text <> '' GROUP BY key_text",
    "p5_term_totals": f"WITH {TERMS}, {_TOTALS} SELECT key_text, total FROM tt",
    "p5_found": f"""WITH {TERMS}, {_TOTALS}, {_AUTHORS} SELECT 'author' AS field_name, key_text FROM k WHERE key_text <> '' GROUP BY key_text HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM d)
        UNION ALL SELECT 'token', key_text FROM tt WHERE total >= 0.0073::DOUBLE * (SELECT sum(total) FROM tt)""",
}
