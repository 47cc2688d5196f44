"""A bitmap of wanted keys, of fixed size, that thins a table before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB at most


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``__hit``: false where the key surely isn't in ``wanted``
    (one column), true for all that are and for a share of others that grows
    with the number of wanted keys."""
    own = wanted.select(place(F.col(wanted.columns[0])).alias("p"))
    bits = own.groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = df.withColumn("__p", place(F.col(key))).withColumn("__bucket", F.bitmap_bucket_number("__p")).withColumn("__p", F.bitmap_bit_position("__p"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__p div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, cast(__p % 8 as int))").bitwiseAND(byte) != 0
    joined = at.join(F.broadcast(bits), "__bucket", "left")  # 2048 rows of 4 KB at most
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("__hit"))


def thinned(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted``."""
    return marked(df, key, wanted).where("__hit").drop("__hit")


def without(df: DataFrame, keys: list[str], gone: DataFrame, broadcast: int = 1_000_000) -> DataFrame:
    """``df`` without the rows whose ``keys`` are a row of ``gone``; nulls equal
    each other. Wide rows stay where they are: ``gone`` is broadcast up to a number
    of rows, and beyond it only rows that the bitmap doesn't clear are shuffled."""
    plain, gone = numbered(df), gone.toDF(*(f"gone{i}" for i in range(len(keys))))
    own = [f"c{df.columns.index(k)}" for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"gone{i}")) for i, k in enumerate(own)]
    if gone.limit(broadcast + 1).count() <= broadcast:
        return plain.join(F.broadcast(gone), on, "left_anti").toDF(*df.columns)
    parted = marked(plain, own[0], gone.select("gone0"))
    rest = parted.where("__hit").drop("__hit").join(gone, on, "left_anti")
    return rest.unionByName(parted.where("not __hit").drop("__hit")).toDF(*df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that no other name clashes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
