"""Text to tokens, shingles and fixed-length id arrays."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def shingles(c: Column, k: int) -> Column:
    """Different substrings of length k; the different characters of a text no longer than k."""
    n = F.length(c)
    return F.array_distinct(F.when(n > k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.filter(F.split(c, ""), lambda x: x != "")))


def listed(c: Column, sep: str = ",") -> Column:
    """Members of a list written as one text, in lower case without spaces; empty ones are left out."""
    return F.filter(F.split(F.replace(F.lower(c), F.lit(" "), F.lit("")), sep), lambda x: x != "")


def letter_tokens(c: Column, longer_than: int = 3) -> Column:
    """Lower-case words of letters only, longer than the bound; other characters but spaces vanish."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, "[^a-zA-Z ]", "")), " +"), lambda t: F.length(t) > longer_than)


def clean_tokens(c: Column, least: int = 2, most: int = 20) -> Column:
    """Words of a text with everything but letters and digits as separator: not numbers, of fitting length."""
    return F.filter(F.split(clean_alnum(c), " "), lambda t: ~t.rlike("^[0-9]+$") & F.length(t).between(least, most))


def clean_alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c, F.lit("'"))), "[^0-9a-z]+", " "))


def padded(ids: Column, n: int) -> Column:
    """First n ids, filled up with 0; longer input is cut."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), n)), 1, n)


def vocabulary_ids(tokens: Column, vocabulary: Mapping[str, int], n: int, keep_unknown: bool = True) -> Column:
    """Ids by a short fixed vocabulary; an unknown token is 0 in place, or dropped."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0)))
    return padded(ids if keep_unknown else F.filter(ids, lambda x: x > 0), n)


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def code_points(c: Column, n: int) -> Column:
    """Code points of the first n characters, 0 for '^' and for missing ones."""
    return padded(F.transform(characters(F.substring(c, 1, n)), lambda x: F.when(x == "^", 0).otherwise(F.ascii(x))), n)


def spaced(c: Column) -> Column:
    return F.array_join(characters(F.coalesce(c, F.lit(""))), " ")


def _murmur3(data: bytes, seed: int) -> int:
    """The public 32-bit Murmur 3 of `data`, unsigned."""
    c1, c2, m = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * c1 & m
        k = (k << 15 | k >> 17) * c2 & m
        h ^= k
        if i < whole:
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def murmur3(c: Column, seed: int = 23) -> Column:
    """32-bit Murmur 3 of the text's bytes, unsigned; null for null. Spark's own hash treats the
    last bytes of a text in another way. For distinct tokens, a batch at a time."""

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        known = {t: _murmur3(t.encode(), seed) for t in texts.dropna().unique()}
        return texts.map(known).astype("Int64")

    return hashed(c)


def money(c: Column) -> Column:
    """'$1,234.50' as a number; null if it isn't one."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def hour_of_week(ts: Column) -> Column:
    """Hour of the week counted from the epoch's hour, the clock rounded to the second first."""
    return F.pmod(F.floor(F.round(F.unix_micros(ts) / 1e6) / 3600), F.lit(168)).cast("int")
