"""Distinct counts over huge identifier sets with multiresolution bitmaps.

An identifier's hash picks a level l with probability 2**-(l+1) and one of B bits in that
level's small bitmap. Bitmaps of any rows merge by OR. To count, the lowest level that isn't
saturated becomes the base: the levels from it upwards hold a 2**-base share of the
identifiers, their linear counts are added and scaled back. Small sets are nearly exact
(base 0), and the relative error doesn't grow with the set: with B = 1024 its standard
deviation stays below 4 percent.

A bitmap is stored as cells (level, word, 64 bits), only those with a bit set, so a small set
costs as many cells as it has members and the largest set LEVELS * B / 64 = 512.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one level, and levels; the last takes all that is left.
B, LEVELS = 1_024, 32
#: A level with more bits set than this is saturated (linear counting at a load of about 1.6).
FULL = int(B * 0.8)
STANDARD_ERROR = 0.04


def cells(df: DataFrame, keys: Sequence[str], identifier: str, nullable: Sequence[str] = ()) -> DataFrame:
    """The bitmap cells of each group; rows with a null identifier, or a null key that isn't
    listed in `nullable`, are left out.

    Result: keys, level, word, bits. A repeated identifier sets the same bit again. One
    combining aggregation: a group never sends more than 512 cells from a task."""
    h = F.xxhash64(identifier)
    rest = F.shiftrightunsigned(h, 12)
    level = F.least(F.bit_count(F.bitwise_not(rest).bitwiseAND(rest - 1)), F.lit(LEVELS - 1))
    present = F.col(identifier).isNotNull()
    for c in keys:
        if c in nullable:
            continue
        present = present & F.col(c).isNotNull()
    slot = h.bitwiseAND(F.lit(B - 1))
    rows = df.where(present).select(*keys, level.cast("tinyint").alias("level"), F.shiftright(slot, 6).cast("tinyint").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    return rows.groupBy(*keys, "level", "word").agg(F.bit_or("bits").alias("bits"))


def merged(cell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of coarser groups: the OR of all cells that agree in `keys`."""
    return cell_rows.groupBy(*keys, "level", "word").agg(F.bit_or("bits").alias("bits"))


#: Bits set in one level (at most B, 11 bits) are summed in packs of five levels to a 64-bit number.
_PACK, _BITS = 5, 11


def estimates(cell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result: keys, n_distinct (rounded to whole). `keys` may be empty for the whole table.

    One aggregation of a few whole numbers per group; the rest is arithmetic on its rows, a
    batch at a time (as one expression it would outgrow the size of generated code)."""
    level, ones = F.col("level").cast("int"), F.bit_count("bits").cast("bigint")
    packs = [F.sum(F.when(F.floor(level / _PACK) == i, F.call_function("shiftleft", ones, (level % _PACK * _BITS).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"__p{i}") for i in range(-(-LEVELS // _PACK))]
    rows = (cell_rows.groupBy(*keys) if keys else cell_rows).agg(*packs)
    schema = ", ".join([*[f"`{c}` {cell_rows.schema[c].dataType.simpleString()}" for c in keys], "n_distinct bigint"])
    return rows.mapInArrow(_estimated(len(keys), [*keys, "n_distinct"]), schema)


#: Linear count of a level by its number of bits set.
_LINEAR = -B * np.log1p(-np.minimum(np.arange(B + 1), B - 1) / B)


def _estimated(keys: int, names: list[str]):
    """Keys and packed sums to keys and estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.arange(LEVELS)
        for b in batches:
            packs = np.stack([b.column(keys + i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(b.num_columns - keys)], 1)
            z = packs[:, levels // _PACK] >> (levels % _PACK * _BITS) & (2**_BITS - 1)
            base = np.where(z[:, :-1] > FULL, levels[1:], 0).max(1, initial=0)
            linear = np.where(levels >= base[:, None], _LINEAR[z], 0).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(np.round(2.0**base * linear).astype(np.int64))], names=names)

    return run
