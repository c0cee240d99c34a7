"""Top N within every group by merging sorted runs with a loser tree.

Each map task sorts its rows into a run ordered by (bucket, group, score desc, tie, id) and keeps at most N distinct ids of a
group, so a group of millions sends N rows a run. A run travels as one row of arrays a bucket: its order is kept
by construction and nothing is sorted again. A bucket's runs are merged by a loser tree as they arrive; after N outputs of a group every run
seeks to the next group. Whenever ``MERGE_ROWS`` are held they become one run of N rows a group, so a bucket of any number of runs takes the room of its result.
The number of buckets follows the number of input partitions, so that result does not grow with the data.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.session import shuffle_partitions

#: Rows that a map task gathers before it closes a run, and rows of one bucket that a merge holds before it makes one run of them.
RUN_ROWS, MERGE_ROWS = 250_000, 500_000


class LoserTree:
    """k-way merge of sorted sequences of keys; ``head`` is the run with the least key, ``seek`` moves one run on."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.keys: list[tuple | None] = [r[0] if r else None for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winner = list(range(self.size)) if self.size == 1 else [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.head = winner[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x <= y)

    def _replay(self, run: int) -> None:
        """Only right for the run at the head: its path is the one whose losers it beat."""
        node, now, keys, losers = (run + self.size) // 2, run, self.keys, self.losers
        while node:
            other = losers[node]
            x, y = keys[now], keys[other]
            if x is None or (y is not None and y < x):
                losers[node], now = now, other
            node //= 2
        self.head = now

    def key(self) -> tuple | None:
        return self.keys[self.head]

    def seek(self, position: int) -> None:
        """Moves the head run to ``position``."""
        run = self.head
        self.at[run] = position
        rows = self.runs[run]
        self.keys[run] = rows[position] if position < len(rows) else None
        self._replay(run)

    def next(self) -> None:
        self.seek(self.at[self.head] + 1)


def merge_top(runs: list[list[tuple]], n: int) -> Iterator[tuple[tuple, int]]:
    """First ``n`` distinct keys of each group (a key's first part) with their ranks, from sorted runs."""
    groups = [[k[0] for k in r] for r in runs]
    tree = LoserTree(runs)
    group, given, before = None, 0, None
    while (key := tree.key()) is not None:
        if key[0] != group:
            group, given, before = key[0], 0, None
        if given >= n:  # seek: this run's next group; the others follow as they come to the head
            tree.seek(bisect_right(groups[tree.head], group, tree.at[tree.head]))
            continue
        if key != before:
            given, before = given + 1, key
            yield key, given
        tree.next()


def top_n(df: DataFrame, group: str, score: str, tie: str, ident: str, n: int = 3, buckets: int | None = None, run_rows: int = RUN_ROWS, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``(group, ident, tie, score, rank)``: the ``n`` best rows of every group by ``score`` descending, then ``tie``
    ascending (binary order), then ``ident`` ascending.

    Rows with a null group, tie, ident or score, or a score that is not finite, never count; rows equal in all four columns
    count once. Groups may be of any size; empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, tie, ident)}
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), (-s).alias("s"), F.col(tie).alias("t"), F.col(ident).alias("i")).where(
        "g is not null and t is not null and i is not null and s is not null and not isnan(s) and abs(s) < double('infinity')"
    )
    b = buckets or max(shuffle_partitions(spark), df.rdd.getNumPartitions())
    rows = rows.select(F.pmod(F.xxhash64("g"), F.lit(b)).cast("int").alias("bucket"), "g", "s", "t", "i")

    def run_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(batches).combine_chunks()
        x = x.take(pc.sort_indices(x, [(c, "ascending") for c in ("bucket", "g", "s", "t", "i")])).combine_chunks()
        col = {c: x.column(c).combine_chunks() if isinstance(x.column(c), pa.ChunkedArray) else x.column(c) for c in x.column_names}
        step = {c: pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False) for c, a in col.items()}
        first = np.append(True, step["g"] | step["bucket"]) if x.num_rows else np.zeros(0, bool)
        new = first.copy()
        new[1:] |= step["s"] | step["t"] | step["i"]
        x, first = x.filter(pa.array(new)), first[new]
        at = np.arange(len(first))
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        x = x.filter(pa.array(rank < n)).combine_chunks()
        bucket = x.column("bucket").to_numpy()
        ids, starts = np.unique(bucket, return_index=True)
        offsets = pa.array(np.append(starts, len(bucket)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x.column(c).combine_chunks()) for c in ("g", "s", "t", "i")]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *lists], names=["bucket", "g", "s", "t", "i"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for x in batches:
            held.append(x)
            count += x.num_rows
            if count >= run_rows:
                yield run_of(held)
                held, count = [], 0
        if count:
            yield run_of(held)

    types = {c: rows.schema[c].dataType for c in ("g", "i", "t")}

    def merged(runs: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        found = list(merge_top(runs, n))
        k = [[key[j] for key, _ in found] for j in range(4)]
        yield pa.RecordBatch.from_arrays([
            pa.array(k[0], to_arrow_type(types["g"])), pa.array(k[3], to_arrow_type(types["i"])), pa.array(k[2], to_arrow_type(types["t"])),
            pc.negate(pa.array(k[1], pa.float64())), pa.array([r for _, r in found], pa.int32()),
        ], names=["g", "i", "t", "s", "rank"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, count = None, [], 0
        for x in batches:
            for k in range(x.num_rows):
                if (now := x.column(0)[k].as_py()) != bucket:
                    if held:
                        yield from merged(held)
                    bucket, held, count = now, [], 0
                held.append(list(zip(*(x.column(j)[k].as_py() for j in range(1, 5)), strict=True)))
                count += len(held[-1])
                if count >= merge_rows and len(held) > 1:
                    held = [[key for key, _ in merge_top(held, n)]]
                    count = len(held[0])
        if held:
            yield from merged(held)

    stored = rows.mapInArrow(runs, f"bucket int, g array<{kinds[group]}>, s array<double>, t array<{kinds[tie]}>, i array<{kinds[ident]}>")
    best = stored.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, f"g {kinds[group]}, i {kinds[ident]}, t {kinds[tie]}, s double, rank int")
    return best.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("t").alias(tie), F.col("s").alias(score), "rank")
