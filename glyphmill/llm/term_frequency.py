"""Frequency of every distinct value: range-partitioned external sort of (term, record, id) and a run-length scan.

Rows are range-partitioned by the whole key, so a term that stands in a third of all rows is cut over many partitions; equal
keys never part. Spark's sorter spills and merges; the scan holds one row between batches. Partial runs of a term that
crosses a partition edge are added up by a combining aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import cut


def _changes(a: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    out = np.ones(len(a), bool)
    if len(a) > 1:
        null = pc.is_null(a).to_numpy(zero_copy_only=False)
        differ = pc.fill_null(pc.not_equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] = differ | (null[1:] != null[:-1])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["term", "occurrences", "records"]
    last: pa.Table | None = None  # the row before this batch
    open_run: list | None = None  # term, occurrences, records of the run not yet ended
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        joined = pa.concat_tables([last, t]).combine_chunks() if last is not None else t
        term, rec, ident = (joined.column(k).combine_chunks() for k in range(3))
        skip = 0 if last is None else 1
        new_term = _changes(term)
        new_rec = new_term | _changes(rec)
        new_id = new_rec | _changes(ident)
        n = joined.column(3).combine_chunks().to_numpy(zero_copy_only=False)
        occurrences = np.where(new_id, n, 0)[skip:]
        records = (new_rec & pc.is_valid(rec).to_numpy(zero_copy_only=False))[skip:].astype(np.int64)
        starts = np.flatnonzero(new_term[skip:])
        last = t.slice(t.num_rows - 1)
        if open_run and (not len(starts) or starts[0] > 0):  # the batch begins inside the open run
            end = starts[0] if len(starts) else b.num_rows
            open_run[1] += int(occurrences[:end].sum())
            open_run[2] += int(records[:end].sum())
        if not len(starts):
            continue
        occ, recs = np.add.reduceat(occurrences, starts), np.add.reduceat(records, starts)
        terms = b.column(0).take(pa.array(starts))
        out = [terms[:-1], pa.array(occ[:-1]), pa.array(recs[:-1])]
        if open_run:
            out = [pa.concat_arrays([pa.array([v], x.type), x]) for v, x in zip(open_run, out, strict=True)]
        open_run = [terms[-1].as_py(), int(occ[-1]), int(recs[-1])]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays(out, names=names)
    if open_run:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in open_run], names=names)


def term_frequencies(pairs: DataFrame, term: str = "term", record: str = "record", ident: str | None = None, count: str | None = None) -> DataFrame:
    """``(term, occurrences, records)`` for every distinct term of ``pairs``.

    ``record`` names the record a term stands in (null: counted as an occurrence, in no record); ``ident`` one delivery key:
    rows equal in term, record and ident count once (default: the record itself). ``count`` is how often the term occurs in
    such a row (default 1). Rows with a null term are left out. An empty input gives an empty result.
    """
    rows = pairs.where(F.col(term).isNotNull()).select(
        F.col(term).alias("term"), F.col(record).alias("rec"),
        (F.col(ident) if ident else F.lit(0)).alias("ident"),
        (F.col(count).cast("bigint") if count else F.lit(1).cast("bigint")).alias("n"),
    )
    # the range bounds are sampled in a pass of their own: the rows are written once, so that folding and counting before it run once
    ordered = cut(rows).repartitionByRange("term", "rec", "ident").sortWithinPartitions("term", "rec", "ident")
    runs = ordered.mapInArrow(_scan, "term string, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(freq: DataFrame, rare, common) -> DataFrame:  # noqa: ANN001
    """Adds ``mark``: ``rare``, ``common`` or null (useful), by two conditions; rare wins where both hold."""
    return freq.withColumn("mark", F.when(rare, "rare").when(common, "common"))
