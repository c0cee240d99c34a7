"""Ranks and running sums by group, in which a group of any size is spread over tasks.

Rows are range-partitioned by group and order and written once. Numbers within a partition come from a window over (partition, group); what a group has in
earlier partitions follows from the first and the last group of each partition, one small row a partition on the driver, since only these can go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import cut


def running(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column | str] | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` = 1, 2, ... in each group of ``keys`` (nulls are a group) and, for each of ``sums``, the sum of its column up to and including the row.

    Rows of one group should be told apart by ``order``; else ties are numbered in any order. An empty table gives an empty result.
    """
    sums = sums or {}
    values = {f"_v{k}": (F.col(c) if isinstance(c, str) else c) for k, c in enumerate(sums.values())}
    by = [*map(F.col, keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ordered = cut(df.withColumns(values).repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    total = [F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(v, F.lit(0))).alias(f"_s{v}") for v in values]]
    ends = ordered.groupBy("_part", *keys).agg(*total, F.min("_row").alias("_at"))
    whole = F.struct("_at", F.struct(*keys).alias("k") if keys else F.lit(0).alias("k"), "_n", *[f"_s{v}" for v in values])
    edges = sorted(ends.groupBy("_part").agg(F.min(whole).alias("a"), F.max(whole).alias("b"), F.count(F.lit(1)).alias("groups")).collect(), key=lambda r: r["_part"])  # one row a partition
    names = ["_n", *(f"_s{v}" for v in values)]
    carries, key, carry = [], None, None
    for r in edges:
        first, last = r.a, r.b
        got = carry if carry is not None and first.k == key else None
        if got is not None:
            carries.append((r["_part"], *got))
        own = [last[c] for c in names]
        carry = [x + y for x, y in zip(own, got, strict=True)] if got is not None and r.groups == 1 else own
        key = last.k
    w = Window.partitionBy("_part", *keys).orderBy("_row")
    out = ordered.withColumn(rank, F.row_number().over(w).cast("bigint"))
    for name, v in zip(sums, values, strict=True):
        out = out.withColumn(name, F.sum(F.coalesce(v, F.lit(0))).over(w))
    if carries:
        kinds = ["_part int", "_first bigint", "_n bigint", *(f"`_s{v}` {ends.schema[f'_s{v}'].dataType.simpleString()}" for v in values)]
        first_rows = {r["_part"]: r.a["_at"] for r in edges}
        table = df.sparkSession.createDataFrame([(p, first_rows[p], *c) for p, *c in carries], ", ".join(kinds))
        # the first group of a partition is the one whose rows begin at the partition's first row
        begins = F.min("_row").over(Window.partitionBy("_part", *keys))
        out = out.withColumn("_begins", begins).join(F.broadcast(table), "_part", "left")
        more = lambda c: F.when(F.col("_begins") == F.col("_first"), F.col(c))
        out = out.withColumn(rank, F.col(rank) + F.coalesce(more("_n"), F.lit(0)))
        for name, v in zip(sums, values, strict=True):
            out = out.withColumn(name, F.col(name) + F.coalesce(more(f"_s{v}"), F.lit(0)))
    return out.select(*df.columns, rank, *sums)
