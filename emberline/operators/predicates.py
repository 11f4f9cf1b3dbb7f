"""Projections, filters, null handling and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import clean as C


def project(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the columns of `names` (old to new), in that order."""
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def regular_names(df: DataFrame) -> DataFrame:
    """Column names without spaces around them, and with one underscore for spaces in them. Names
    that become equal raise."""
    names = ["_".join(c.split()) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns with the same regular name: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as flat columns, a.b becoming a<sep>b, to any depth."""

    def walk(schema: T.StructType, path: str, name: str):
        for f in schema.fields:
            p, n = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p + ".", n + sep)
            else:
                yield F.col(p).alias(n)

    return df.select(*walk(df.schema, "", ""))


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def any_null(*cols: str) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in cols])


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """1 if the text contains one of the parts, null (not 0) if it doesn't."""
    return F.when(reduce(or_, [c.contains(p) for p in parts]), F.lit(1))


def remap(c: Column, table: Mapping, default=None) -> Column:
    """Values by table; others become `default`, or stay if that is None."""
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(c if default is None else F.lit(default))


def drop_non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose `cols` are all neither null, NaN nor infinite."""
    return df.where(reduce(and_, [C.finite(c).isNotNull() for c in cols]))


def impute_median(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """NaN, infinite and null values of `cols` replaced by the median of the rest: the exact one,
    which one task finds from all different values, or with `accuracy` one whose rank is off by
    at most 1/accuracy of the rows, from mergeable summaries.

    The medians are one row; it is joined as such and never grows. A column without values stays null."""
    clean = df.withColumns({c: C.finite(c) for c in cols})
    medians = clean.agg(*[(F.median(c) if accuracy is None else F.percentile_approx(c, 0.5, accuracy)).alias(f"__m_{c}") for c in cols])
    return clean.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def non_null_columns(df: DataFrame) -> list[str]:
    """Columns that have at least one value, found in one pass."""
    row = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column_name, n_missing, pct_missing (one decimal) of the columns with nulls; one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in cols])).alias("x"))
    return rows.select("x.column_name", "x.n_missing", F.round(C.div(F.col("x.n_missing") * 100, "n"), 1).alias("pct_missing")).where("n_missing > 0")


def frequency_diversity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column_name, n_frequencies: how many different value counts each column has (nulls not counted).

    One pass over (column, value) pairs instead of one job for each column."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*").where("v IS NOT NULL")
    return pairs.groupBy("column_name", "v").agg(F.count("*").alias("c")).groupBy("column_name").agg(F.count_distinct("c").alias("n_frequencies"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r for each pair a before b: Pearson's r from moments of the rows where both are
    there, all pairs in one pass; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.when(both[a, b], F.col(a).cast("double")), F.when(both[a, b], F.col(b).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"x{i}"), F.sum(y).alias(f"y{i}"), F.sum(x * x).alias(f"xx{i}"), F.sum(y * y).alias(f"yy{i}"), F.sum(x * y).alias(f"xy{i}")]
    one = df.agg(*aggs)

    def r(i: int) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"{k}{i}") for k in ("n", "x", "y", "xx", "yy", "xy"))
        return F.try_divide(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y))

    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i).alias("r")) for i, (a, b) in enumerate(pairs)])))


def uncorrelated(df: DataFrame, cols: Sequence[str], above: float = 0.95) -> list[str]:
    """Columns left when each that correlates above the bound with any earlier one is dropped."""
    drop = {row.b for row in correlations(df, cols).where(F.col("r") > above).collect()}
    return [c for c in cols if c not in drop]


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den; -1 where only the denominator is 0, null where both are."""
    return F.when(den != 0, num.cast("double") / den).when(num > 0, F.lit(-1.0))
