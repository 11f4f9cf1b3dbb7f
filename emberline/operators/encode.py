"""Categorical encoders as fitted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.sequences import numbered


def ordinal_table(df: DataFrame, c: str) -> DataFrame:
    """value, ordinal from 1 in value order; 0 is left for unknown values."""
    return numbered(df.select(F.col(c).alias("value")).where("value IS NOT NULL").distinct(), ["value"], "r").select("value", (F.col("r") + 1).alias("ordinal"))


def binary_encode(df: DataFrame, c: str, table: DataFrame, bits: int, prefix: str) -> DataFrame:
    """`df` with the bits of the value's ordinal, highest first; unknown and null values are all 0."""
    j = df.join(table.withColumnRenamed("value", c), c, "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
    return j.withColumns({f"{prefix}_{bits - 1 - i}": F.shiftright("ordinal", i).bitwiseAND(F.lit(1)).cast("int") for i in reversed(range(bits))}).drop("ordinal")


def one_hot(c: str, values: Sequence, prefix: str, sep: str = "_") -> list[Column]:
    return [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{prefix}{sep}{v}") for v in values]


def char_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """ch, id: the different characters of all texts in code-point order. Characters are made
    distinct inside each text and combined before the shuffle."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).where("ch <> ''").distinct()
    return numbered(chars, ["ch"], "id").select("ch", "id")


def decode_characters(ids: DataFrame, key: str, vocabulary: DataFrame, out: str = "text") -> DataFrame:
    """key and the text whose characters have the ids, in order of pos; unknown ids are left out."""
    return ids.join(vocabulary, "id").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias(out))


def encode_characters(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """key, pos (from 0), id of each character of each text."""
    chars = df.select(key, F.posexplode(F.filter(F.split(text, ""), lambda x: x != "")).alias("pos", "ch"))
    return chars.join(vocabulary, "ch").select(key, "pos", "id")
