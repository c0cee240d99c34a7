"""Running numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running
from glyphmill.session import cut

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within the partition below


def number_rows(df: DataFrame, out: str, *order: str) -> DataFrame:
    """``df`` with ``out`` = 1, 2, ... in the order of the given columns (nulls first; make them unique for a stable result).

    Rows are range-partitioned and sorted, written once, then numbered from the partitions' sizes: one small row a
    partition reaches the driver.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = ordered.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", _ROW_BITS)
    sizes = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    first = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in offsets for x in pair]), part)
    return marked.withColumn(out, first + F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("_m")


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "impostor_id") -> DataFrame:
    """``df`` with ``out`` = 1, 2, ... within each group of ``keys``: the running id of a document's impostors or chunks. A group of any size is spread over tasks."""
    return running(df, keys, order, rank=out)
