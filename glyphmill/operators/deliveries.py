"""Rows that were delivered again: each key once, without shuffling the rows of keys that came once.

A narrow aggregate over hashed keys finds those that stand in several rows; they are marked in a bitmap of fixed size, which is broadcast. Rows whose bit
is not set are the only ones of their key and go on where they are; the few others are settled by an exact ``dropDuplicates``. Equal hashes or
bits only send a row the longer way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2 ** BITS bits: 16 MB, whatever the data.
BITS = 27


def bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``(_bucket, _bits)``: the values of a column of 64-bit hashes as bits, of which ``2 ** bits`` / 8 bytes at most come out, whatever the data."""
    place = keys.select((F.pmod(F.col(key), F.lit(1 << bits)) + 1).alias("_p"))
    return place.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))


def with_bit(df: DataFrame, key: str, marks: DataFrame, out: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``out``: whether the bit of ``key`` is set in a bitmap; false says that the value is not among those marked, true that it may be."""
    rows = df.withColumn("_p", F.pmod(F.col(key), F.lit(1 << bits)) + 1).withColumn("_bucket", F.bitmap_bucket_number("_p"))
    rows = rows.join(F.broadcast(marks), "_bucket", "left")  # at most 2 ** bits / 8 bytes
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn(out, F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))).drop("_p", "_bucket", "_bits")


def one_delivery(df: DataFrame, keys: str | list[str], *columns: str, bits: int = BITS) -> DataFrame:
    """``(*keys, *columns)``: one row for each value of ``keys`` (null is a value), any of them where several were delivered.

    Rows of one key are taken to be the same row delivered again. The table is read twice, the first time its keys only. Empty input gives an empty result.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key = F.xxhash64(*keys)
    again = df.select(key.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = with_bit(df.select(*keys, *columns, key.alias("_h")), "_h", bitmap(again, "_h", bits), "_several", bits)
    once = rows.where(~F.col("_several")).select(*keys, *columns)
    return once.unionByName(rows.where("_several").select(*keys, *columns).dropDuplicates(keys))
