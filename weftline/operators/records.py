"""Filters, lookups, set operations and picks over records, as DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, wanted: dict[str, object], *, parts: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet every wish; blank wishes (null, empty) ask nothing.

    A list or set asks for membership, a pair (low, high) as a tuple for a closed range with open ends
    where null; a value asks for equality, in columns of ``parts`` for a substring in any case, in those of ``lists``
    for an element. A null column meets no wish.
    """

    def one(name: str, want: object) -> Column:
        c = F.col(name)
        if isinstance(want, tuple):
            low, high = want
            return (c >= low if low is not None else c.isNotNull()) & (c <= high if high is not None else c.isNotNull())
        if isinstance(want, list | set | frozenset):
            return F.arrays_overlap(c, F.array(*map(F.lit, want))) if name in lists else c.isin(*want)
        if name in lists:
            return F.array_contains(c, want)
        return F.contains(F.lower(c), F.lit(str(want).lower())) if name in parts else c == want

    asked = [one(n, w) for n, w in wanted.items() if w is not None and w != "" and w != [] and w != set()]
    return df.where(reduce(lambda a, b: a & b, asked)) if asked else df


def compared_sets(found: Column, true: Column) -> tuple[Column, Column, Column]:
    """Sorted arrays of what is in both, found alone and true alone."""
    return tuple(F.array_sort(x).alias(n) for n, x in (("tp", F.array_intersect(found, true)), ("fp", F.array_except(found, true)), ("fn", F.array_except(true, found))))


def at_place(df: DataFrame, array: str, place: Column, name: str) -> DataFrame:
    """``df`` with the element of an array at a place counted from 0; rows whose place is out of range go."""
    return df.withColumn(name, F.get(array, place)).where((place >= 0) & (place < F.size(array)))


def firsts(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps no more than ``n`` of a key before the shuffle."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def not_yet(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys ``done`` lacks, for a sink that goes on where it stopped."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def seeded(*columns: str, seed: str) -> Column:
    """An order by hash that a seed fixes, for samples and shuffles that can be repeated."""
    return F.sha1(F.concat_ws("|", F.lit(seed), *columns).cast("binary"))


def facets(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """facet, value, n: how often each value stands in each column of ``names`` (column: facet), elements of lists one by one, in one pass.

    Columns of the same facet are counted together. Nulls, as values or as elements, don't count; a list that repeats a value counts it again.
    """
    def told(column: str) -> Column:
        many = df.schema[column].dataType.typeName() == "array"
        values = F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")) if many else F.array(F.col(column).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(names[column]).alias("facet"), v.alias("value")))

    return df.select(F.explode(F.concat(*map(told, names))).alias("f")).select("f.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
