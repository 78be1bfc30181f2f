"""Sets of 64-bit marks as bitmaps of fixed size: a semi-join filter that may be broadcast whatever the set's size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
PART = 32768


def bitmap_parts(marks: DataFrame, mark: str, bits: int = BITS) -> DataFrame:
    """part, bits: at most ``bits`` / 32768 rows of 4096 bytes, one bit for each mark modulo ``bits``, a power of two."""
    if bits < 1 or bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    at = F.col(mark).bitwiseAND(F.lit(bits - 1))
    return marks.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % PART).alias("bits"))


def bitmap_array(marks: DataFrame, mark: str, bits: int = BITS) -> np.ndarray:
    """The bitmap as booleans on the driver: ``bits`` bytes, however many marks there are."""
    out = np.zeros(max(bits, PART), dtype=bool)
    for part in bitmap_parts(marks, mark, bits).collect():
        out[part["part"] * PART : (part["part"] + 1) * PART] = np.unpackbits(np.frombuffer(bytes(part["bits"]), dtype=np.uint8), bitorder="little")
    return out[:bits]


def in_bitmap(rows: DataFrame, mark: Column, parts: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose mark may be in the set: all that are, and few others. The bitmap is broadcast; its size is fixed."""
    at = mark.bitwiseAND(F.lit(bits - 1))
    place = (at % PART).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    parts = parts.select(F.col("part").alias("__part"), F.col("bits").alias("__bits"))
    kept = rows.withColumn("__part", F.shiftright(at, 15)).join(F.broadcast(parts), "__part")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place.bitwiseAND(F.lit(7)) + 1)
    return kept.where(byte.bitwiseAND(bit) != 0).drop("__part", "__bits")
