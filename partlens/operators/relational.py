"""Relational operators: as-of joins, latest and first rows, precedence unions, emulated upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, by: Sequence[str] = (), bucket: Callable[[str], Column] | None = None) -> DataFrame:
    """left with the value of the last right row at or before its time, within ``by``.

    One union, one shuffle and a running last value: n log n, whatever the distance. With ``bucket``, a function of time that
    never falls, rows meet by key and bucket, so that few keys still make many tasks; what a bucket starts with comes from
    the last values of those before, of which there is a row each. Right rows need one value for a time; several are reduced to the
    largest.
    """
    cols, keys = left.columns, list(by)
    r = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias(left_time)).agg(F.max(value).alias("__v"))
    both = left.withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    order = [F.col(left_time).asc_nulls_first(), "__side"]
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*cols, value)
    both = both.withColumn("__b", bucket(left_time))
    ends = both.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(left_time))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    start = start.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c"), "__start")
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    on = F.col("__b").eqNullSafe(F.col("__c"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return x.join(start, on, "left").withColumn(value, F.when(F.col(left_time).isNotNull(), F.coalesce(value, "__start"))).select(*cols, value)


def precedence_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and of second what first has no key for."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new replaces old rows of equal keys."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """Rows of old within the scope give way to new."""
    return old.where(~F.coalesce(scope, F.lit(False))).unionByName(new.select(*old.columns))


def top_n_others(df: DataFrame, key: str, n: int, measure: str = "n", rest: str = "Others") -> DataFrame:
    """The n largest keys by count and one row for all others."""
    counts = df.groupBy(key).agg(F.count("*").alias(measure))
    top = counts.orderBy(F.desc(measure), F.asc(key)).limit(n).select(F.col(key).alias("__k"))
    both = counts.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("__k")), "left")  # n rows
    return both.groupBy(F.coalesce("__k", F.lit(rest)).alias(key)).agg(F.sum(measure).alias(measure))
