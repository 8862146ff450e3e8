"""Bloom filters as tables: (block, bits), kept by week or any other key, merged by bitwise or.

A value belongs to one block of 32768 bits and sets four of them. Blocks are rows, so a filter is built, merged and
probed by the cluster and none of it passes the driver. Filters to be merged need the same number of blocks; at
10 bits a value about 1 % of absent values seem present, and a present one always does. Null is no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # what bitmap_construct_agg fills
HASHES = 4
#: Filters of so many blocks (4 KB each) go along with the tasks; larger ones are joined by block.
SMALL_BLOCKS = 4096


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(1)), F.lit(blocks)).cast("int")


def _spots(value: Column) -> list[Column]:
    h = F.xxhash64(value, F.lit(2))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]


def build(rows: DataFrame, value: str, blocks: int, *keys: str) -> DataFrame:
    """(*keys, block, bits) of the values of rows, a filter for each of the keys."""
    spots = rows.filter(F.col(value).isNotNull()).select(*keys, _block(F.col(value), blocks).alias("block"), F.explode(F.array(*_spots(F.col(value)))).alias("spot"))
    return spots.groupBy(*keys, "block").agg(F.bitmap_construct_agg("spot").alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    """(block, bits): one filter that holds what any of them holds."""
    return filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def marked(rows: DataFrame, value: str, one: DataFrame, blocks: int, mark: str = "maybe") -> DataFrame:
    """rows with `mark`: false where the filter surely lacks the value."""
    bits = one.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    byte = lambda spot: F.conv(F.hex(F.substring("_bits", (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.lit(True)
    for spot in _spots(F.col(value)):
        held = held & (F.getbit(byte(spot), spot.bitwiseAND(F.lit(7)).cast("int")) == 1)
    side = F.broadcast(bits) if blocks <= SMALL_BLOCKS else bits
    return rows.withColumn("_block", _block(F.col(value), blocks)).join(side, "_block", "left").withColumn(mark, F.col("_bits").isNotNull() & F.coalesce(held, F.lit(False))).drop("_block", "_bits")
