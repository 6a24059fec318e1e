"""Operations on half-open integer ranges [start, end), grouped by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges of each key with those that overlap or touch merged."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.select(*keys, start, end, F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)).alias("__new"))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def intersect_ranges(a: DataFrame, b: DataFrame, keys: list[str], width: int = 256, start: str = "start", end: str = "end") -> DataFrame:
    """Common parts of ranges with equal keys; ranges that touch have a part of length 0.

    Ranges are dealt to the bins of ``width`` they reach, which makes the overlap an equi
    join; a pair is kept in the bin of its common start alone.
    """
    bins = lambda df, s, e: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    x = bins(a.select(*keys, start, end), start, end)
    y = bins(b.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e")), "__s", "__e")
    both = x.join(y, [*keys, "__bin"]).where((F.col(start) <= F.col("__e")) & (F.col("__s") <= F.col(end)))
    low, high = F.greatest(F.col(start), F.col("__s")), F.least(F.col(end), F.col("__e"))
    return both.where(F.floor(low / width) == F.col("__bin")).select(*keys, low.alias(start), high.alias(end))


def subtract_range(df: DataFrame, target_start: Column, target_end: Column, start: str = "start", end: str = "end") -> DataFrame:
    """What is left of each row's range without the target: none, one or two rows."""
    s, e = F.col(start), F.col(end)
    left = F.struct(s.alias("s"), F.least(e, target_start).alias("e"))
    right = F.struct(F.greatest(s, target_end).alias("s"), e.alias("e"))
    apart = (target_end <= s) | (target_start >= e)
    whole = F.array(F.struct(s.alias("s"), e.alias("e")))
    pieces = F.when(apart, whole).otherwise(F.filter(F.array(left, right), lambda p: p["s"] < p["e"]))
    others = [c for c in df.columns if c not in (start, end)]
    return df.select(*others, F.explode(pieces).alias("__p")).select(*others, F.col("__p.s").alias(start), F.col("__p.e").alias(end))


def range_sizes(df: DataFrame, keys: list[str], name: str = "size", start: str = "start", end: str = "end") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).cast("bigint").alias(name))


def range_scores(retrieved: DataFrame, relevant: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """iou, precision, recall and f1 of retrieved ranges against relevant ones, by key; 0 where a part is missing."""
    got, want = union_ranges(retrieved, keys), union_ranges(relevant, keys)
    both = union_ranges(intersect_ranges(got, want, keys, width), keys)
    sizes = range_sizes(got, keys, "got").join(range_sizes(want, keys, "want"), keys, "full").join(range_sizes(both, keys, "both"), keys, "left").na.fill(0, ["got", "want", "both"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    got_, want_, both_ = F.col("got"), F.col("want"), F.col("both")
    return sizes.select(*keys, ratio(both_, got_ + want_ - both_).alias("iou"), ratio(both_, got_).alias("precision"), ratio(both_, want_).alias("recall"), ratio(2 * both_, got_ + want_).alias("f1"))
