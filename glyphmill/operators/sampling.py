"""Reproducible samples without replacement for many requests from one large pool, without ranking the pool for each.

The pool is put into one random order, by md5, as a ring. A request begins at a place of its own and takes the next ``k`` items that it may have: successive
items of a random order are a random sample. Where its sample ends follows from nothing but the ring, however it is found: in a first pass
a request reads about as many items as it should need, and those that meet too few read on, as far as round the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.numbering import number_rows
from glyphmill.session import cut

#: Items of a piece of the ring that requests are joined with.
PIECE = 16


def hash_number(text: Column) -> Column:
    """Number of 60 bits from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def ring(pool: DataFrame, seed: str = "0") -> DataFrame:
    """``pool`` (item, ...) with ``pos`` 0, 1, ... by the md5 of seed and item, ties by item."""
    return number_rows(pool.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("item").cast("string")))), "_p", "_h", "item").withColumn("pos", F.col("_p") - 1).drop("_h", "_p")


def _may_have(author: str = "author") -> Column:
    a = F.col(author)
    return a.isNull() | ((F.col("not_a").isNull() | (a != F.col("not_a"))) & (F.col("not_b").isNull() | (a != F.col("not_b"))))


def sample_for(requests: DataFrame, pool: DataFrame, seed: str = "0", share: float | None = None, replace: bool = False) -> DataFrame:
    """``(req_id, item, rank)``: for each request the first ``k`` items from its place on the ring on whose author is neither ``not_a`` nor ``not_b``.

    ``requests`` is (req_id string, k, not_a, not_b), ``pool`` (item, author) with distinct items; items of null author are for all. With ``share`` a request takes
    that share of the items it may have (at least one) in place of ``k``. A request for more items than there are for it raises, as does any from an empty pool; with
    ``replace`` it goes round the ring again instead.
    """
    items = cut(ring(pool.select("item", "author"), seed))
    size = items.count()
    per_author = items.where("author is not null").groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    taken = lambda c: per_author.select(F.col("author").alias(c), F.col("n").alias(f"_{c}"))
    asked = requests.join(taken("not_a"), "not_a", "left").join(taken("not_b"), "not_b", "left")
    out = F.coalesce("_not_a", F.lit(0)) + F.when(F.col("not_a").isNotNull() & (F.col("not_a") == F.col("not_b")), 0).otherwise(F.coalesce("_not_b", F.lit(0)))
    asked = asked.withColumn("_free", F.lit(size) - out)
    k = F.greatest(F.floor(F.col("_free") * share + 0.5), F.lit(1)) if share is not None else F.col("k")
    asked = asked.withColumn("k", k.cast("bigint")).where("k > 0")
    first = F.pmod(hash_number(F.concat_ws("|", F.lit(seed), "req_id")), F.lit(max(1, size)))
    # the share of items that a request may have tells how far it should have to read; a little more is read at once
    need = F.col("k") * (size / F.greatest(F.col("_free"), F.lit(1)))
    asked = asked.select("req_id", "k", "not_a", "not_b", "_free", first.alias("s"), F.least(F.lit(size), F.ceil(need + 3 * F.sqrt(need) + 4)).cast("bigint").alias("span"))
    asked = cut(asked)
    again = asked.where("k > _free and _free > 0").select("req_id", F.col("k").alias("_k"), F.col("_free").alias("_m")) if replace else None
    if replace:
        asked = asked.withColumn("k", F.when(F.col("_free") > 0, F.least("k", "_free")).otherwise(F.col("k")))
    if (short := asked.where("k > _free").select("req_id", "k", "_free").limit(3).collect()):
        raise ValueError(f"not enough items for {[tuple(r) for r in short]} (request, wanted, there)")
    pieces = -(-size // PIECE)
    on_ring = items.withColumn("piece", F.floor(F.col("pos") / PIECE))
    done: DataFrame | None = None
    while True:
        last = F.least(F.floor((F.col("s") + F.col("span") - 1) / PIECE), F.floor(F.col("s") / PIECE) + pieces)
        reads = asked.withColumn("piece", F.explode(F.sequence(F.floor(F.col("s") / PIECE), last))).withColumn("piece", F.pmod("piece", F.lit(pieces))).distinct()
        far = F.pmod(F.col("pos") - F.col("s"), F.lit(size))
        met = reads.join(on_ring, "piece").withColumn("far", far).where((F.col("far") < F.col("span")) & _may_have())
        rank = F.row_number().over(Window.partitionBy("req_id").orderBy("far"))
        found = cut(met.withColumn("rank", rank).where("rank <= k").select("req_id", "item", "k", "rank"))
        full = found.where("rank = k").select("req_id")
        got = found.join(full, "req_id", "left_semi").select("req_id", "item", "rank")
        done = got if done is None else done.unionByName(got)
        asked = cut(asked.join(full, "req_id", "left_anti").withColumn("span", F.least(F.lit(size), F.col("span") * 4)))
        if not asked.limit(1).count():
            break
    if again is None:
        return done
    turns = F.explode(F.when(F.col("_m").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_k") - F.col("rank")) / F.col("_m")))))
    return done.join(again, "req_id", "left").withColumn("_turn", turns).select("req_id", "item", (F.col("rank") + F.coalesce(F.col("_turn") * F.col("_m"), F.lit(0))).cast("int").alias("rank"))


def sample_within(requests: DataFrame, pool: DataFrame, seed: str = "0") -> DataFrame:
    """``(req_id, grp, item, rank)``: ``k`` items of the request's own group of the pool, by a ring a group.

    ``requests`` is (req_id, grp, k), ``pool`` (grp, item); a group is bounded (the impostors of one document). A request for more than its group has raises.
    """
    order = Window.partitionBy("grp").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("item").cast("string"))), "item")
    items = pool.select("grp", "item", (F.row_number().over(order) - 1).alias("pos"))
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    asked = requests.where("k > 0").join(sizes, "grp", "left")
    enough = F.when(F.col("size") >= F.col("k"), F.col("k")).otherwise(F.raise_error(F.concat(F.lit("not enough items for "), "req_id")).cast("bigint"))
    reads = asked.select("req_id", "grp", "size", F.pmod(hash_number(F.concat_ws("|", F.lit(seed), "req_id")), F.col("size")).alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), enough.cast("bigint") - 1)).alias("far"))
    return reads.withColumn("pos", F.pmod(F.col("s") + F.col("far"), F.col("size"))).join(items, ["grp", "pos"]).select("req_id", "grp", "item", (F.col("far") + 1).cast("int").alias("rank"))
