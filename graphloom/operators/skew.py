"""Joins whose keys are few or hot: rows that cannot match go first, hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a presence map; as rows of 4 KB they are half a megabyte, whatever is entered.
MAP_BITS = 1 << 22
BUCKET_BITS = 32_768  # fixed value: bits of one row of Spark's bitmap functions
#: Rows of one key from which on it is dealt out, and to how many.
HOT_ROWS, SALTS = 100_000, 32


def place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS))


def presence(keys: DataFrame) -> DataFrame:
    """(bucket, bits): one bit for the hash of each row, in at most MAP_BITS / BUCKET_BITS rows."""
    at = place(keys.columns)
    return keys.select(at.alias("at")).groupBy(F.expr(f"at div {BUCKET_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET_BITS).alias("bits"))


def maybe_present(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """rows whose columns may be among keys (same columns): all that are, few that are not.  Nothing is shuffled but the map."""
    bits = presence(keys.select(*columns))
    at, names = F.col("__at"), rows.columns
    octet = F.conv(F.hex(F.substring(F.col("bits"), (at % BUCKET_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(__octet, cast(__at % 8 as int)) & 1") == 1
    found = rows.withColumns({"__at": place(columns)}).withColumn("bucket_", F.expr(f"__at div {BUCKET_BITS}")).join(F.broadcast(bits.withColumnRenamed("bucket", "bucket_")), "bucket_")
    return found.withColumn("__octet", octet).where(set_).select(*names)


def dealt_join(rows: DataFrame, lookup: DataFrame, keys: list[str], by: str, hot_rows: int | None = None) -> DataFrame:
    """Inner join of rows to a lookup that has few rows for each key; keys that hold more than hot_rows of rows
    are dealt out by a hash of column `by`, and their lookup rows are repeated for each part."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (HOT_ROWS if hot_rows is None else hot_rows)).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(many, keys, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = lookup.join(many, keys, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return dealt.join(repeated, [*keys, "__salt"]).drop("__salt")
