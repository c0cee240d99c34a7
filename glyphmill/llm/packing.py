"""Filling fixed-capacity containers: pattern packing by non-negative least squares, residuals by best fit on the histogram.

Everything that decides works on the histogram of lengths, whose size is bounded by the capacity: few-item length patterns
that fill a container are enumerated over ``UNITS`` length classes, their repeat counts are fitted to the histogram by NNLS, rounded,
and turned into patterns of exact lengths; what is left, first of all short items for the open rooms, is added by
best-fit-decreasing on the histogram. Items then find their place by arithmetic: the rank among the items of equal length
selects a slot. Ranks come from counts by (length, hash part); the parts of a length follow from its items, so no length, however common, is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNITS = 128  # length classes of a container for the patterns
PART_ITEMS = 100_000  # items of one length that are numbered together; a length has as many parts as its items ask for


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Non-negative x that minimises |a x - b| (active-set method)."""
    n = a.shape[1]
    gram, to = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * max(a.shape)):
        gain = to - gram @ x
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tol * max(1.0, np.abs(to).max()):
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.linalg.lstsq(gram[np.ix_(p, p)], to[p], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - z[bad], 1e-300))
            x[p] += step * (z - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def full_patterns(units: int) -> list[tuple[int, ...]]:
    """Multisets of one to three length classes that add up to ``units``."""
    three = [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return [(units,), *((a, units - a) for a in range(1, units // 2 + 1)), *three]


def pack_histogram(lengths: np.ndarray, counts: np.ndarray, capacity: int, units: int = UNITS) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {length: items in each})`` that use up the histogram exactly; lengths lie in 1..capacity."""
    left = {int(n): int(c) for n, c in zip(lengths, counts, strict=True) if c > 0}
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    width = -(-capacity // min(units, capacity))
    classes = capacity // width
    by_class: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        by_class.setdefault(-(-n // width), []).append(n)
    if left:
        h = np.zeros(classes + 2)
        for k, ns in by_class.items():
            h[min(k, classes + 1)] = sum(left[n] for n in ns)
        patterns = [p for p in full_patterns(classes) if all(h[k] > 0 for k in p)]
        if patterns:
            a = np.zeros((classes + 2, len(patterns)))
            for j, p in enumerate(patterns):
                for k in p:
                    a[k, j] += 1
            x = nnls(a, h)
            for j in np.argsort(-x, kind="stable"):
                if x[j] < 0.5:
                    break
                p = patterns[j]
                avail = {k: sum(left[n] for n in by_class[k]) for k in set(p)}
                repeat = min(round(x[j]), *(avail[k] // p.count(k) for k in set(p)))
                while repeat > 0:  # the pattern's classes as runs of exact lengths
                    take: dict[int, int] = {}
                    for k in p:
                        n = next(n for n in by_class[k] if left[n] > take.get(n, 0))
                        take[n] = take.get(n, 0) + 1
                    times = min(repeat, *(left[n] // m for n, m in take.items()))
                    for n, m in take.items():
                        left[n] -= m * times
                    rooms.setdefault(capacity - sum(n * m for n, m in take.items()), []).append((times, take))
                    repeat -= times
    _best_fit(left, rooms, capacity)
    return [x for r in sorted(rooms) for x in rooms[r]]


def _best_fit(left: dict[int, int], rooms: dict[int, list[tuple[int, dict[int, int]]]], capacity: int) -> None:
    """Puts every length, longest first, into the smallest open room that holds it; opens containers when none does."""
    open_rooms = np.zeros(capacity + 1, bool)
    for r, kind in rooms.items():
        open_rooms[r] = bool(kind)
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        while left[n] > 0:
            at = n + int(np.argmax(open_rooms[n:])) if open_rooms[n:].any() else -1
            if at < 0:
                each = min(capacity // n, left[n])
                times = left[n] // each
                new = (times, {n: each})
                used = each * times
                room = capacity - each * n
            else:
                times, content = rooms[at].pop()
                open_rooms[at] = bool(rooms[at])
                each = min(at // n, max(1, left[n] // times))
                use = min(times, left[n] // each) if left[n] >= each else 0
                if use < times:
                    rooms[at].append((times - use, content))
                    open_rooms[at] = True
                new = (use, content | {n: content.get(n, 0) + each})
                used, room = use * each, at - each * n
            left[n] -= used
            rooms.setdefault(room, []).append(new)
            open_rooms[room] = True


def _slots(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first container, items in each, tokens in each), ranks ascending."""
    first, by, ranks = 0, {}, {}
    for times, content in plan:
        fill = sum(n * m for n, m in content.items())
        for n, m in content.items():
            by.setdefault(n, []).append((ranks.get(n, 0), first, m, fill))
            ranks[n] = ranks.get(n, 0) + times * m
        first += times
    return {n: np.array(rows, np.int64) for n, rows in by.items()}


def pack(sizes: DataFrame, capacities: dict[str, int], units: int = UNITS, part_items: int = PART_ITEMS) -> DataFrame:
    """``(pack_name, pack_id, doc_id, piece, tokens, pack_tokens, capacity)``: each item of ``sizes`` (doc_id, tokens) in a container.

    An item longer than the capacity is cut into full pieces and a rest, numbered by ``piece`` from 0; all others stay whole. Items of null or
    no tokens take no room and are in no container. doc_id must be unique. Empty input gives an empty result.
    """
    spark = sizes.sparkSession
    caps = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(int(v)).cast("bigint").alias("capacity")) for k, v in sorted(capacities.items())]))
    whole = sizes.where("tokens > 0").select("doc_id", F.col("tokens").cast("bigint").alias("n"), caps.alias("c")).select("doc_id", "n", "c.*")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div capacity as int)")))).select(
        "pack_name", "capacity", "doc_id", "piece", F.least("capacity", F.expr("n - piece * capacity")).alias("tokens")
    )
    # at most one row a length: bounded by the capacities, not by the data
    histogram = pieces.groupBy("pack_name", "tokens").agg(F.count(F.lit(1)).alias("c")).toPandas()
    many = histogram[histogram.c > part_items]
    parts = spark.createDataFrame([(r.pack_name, int(r.tokens), -(-int(r.c) // part_items)) for r in many.itertuples()], "pack_name string, tokens bigint, parts int")
    numbered = pieces.join(F.broadcast(parts), ["pack_name", "tokens"], "left")  # at most one row a length
    pieces = numbered.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    keys = ["pack_name", "tokens", "part"]
    counts = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    slots = {}
    for k, v in sorted(capacities.items()):
        h = histogram[histogram.pack_name == k].sort_values("tokens")
        slots[k] = _slots(pack_histogram(h.tokens.to_numpy(), h.c.to_numpy(), int(v), units), int(v))
    before = Window.partitionBy("pack_name", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys).orderBy("doc_id", "piece")
    ranked = pieces.withColumn("k", F.row_number().over(within)).join(offsets, keys).select(
        "pack_name", "doc_id", "piece", "tokens", "capacity", (F.col("offset") + F.col("k") - 1).alias("rank")
    )
    id_type = sizes.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            tokens, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            pack_id, fill = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            order = np.lexsort((rank, tokens, np.array(names, dtype=object).astype(str)))
            edge = [0, *(k for k in range(1, len(order)) if tokens[order[k]] != tokens[order[k - 1]] or names[order[k]] != names[order[k - 1]]), len(order)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                at = order[lo:hi]
                if not len(at):
                    continue
                rows = slots[names[at[0]]][int(tokens[at[0]])]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                pack_id[at] = rows[k, 1] + (rank[at] - rows[k, 0]) // rows[k, 2]
                fill[at] = rows[k, 3]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pack_id), b.column(1), b.column(2), b.column(3), pa.array(fill), b.column(4)],
                names=["pack_name", "pack_id", "doc_id", "piece", "tokens", "pack_tokens", "capacity"],
            )

    return ranked.mapInArrow(place, f"pack_name string, pack_id bigint, doc_id {id_type}, piece int, tokens bigint, pack_tokens bigint, capacity bigint")


def pack_fill(packed: DataFrame) -> DataFrame:
    """``(pack_name, capacity, packs, tokens, fill)``: containers used and the share of their room that is filled."""
    per = packed.groupBy("pack_name", "capacity", "pack_id").agg(F.sum("tokens").alias("t"))
    return per.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("packs"), F.sum("t").alias("tokens")).withColumn(
        "fill", F.col("tokens") / (F.col("packs") * F.col("capacity"))
    )
