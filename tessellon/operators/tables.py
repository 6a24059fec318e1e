"""Table maintenance as rewrites: upserts, deletes, updates, paging, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.session import written


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name, the sum of a column over all rows before, 0 on the first. ``order`` should leave no ties.

    Rows are range-partitioned, summed within partitions and moved up by the sums of the
    partitions before, of which there is one row each, so no task sees all rows.
    """
    before = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spread = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    own = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b_{n}") for n, c in sums.items()]
    place, _ = written(spread.select("*", *(c.alias(f"__o_{n}") for n, c in sums.items()), *own), "prefix-sums")
    every = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = place.groupBy("__p").agg(*(F.sum(f"__o_{n}").alias(f"__t_{n}") for n in sums))
    whole = whole.select("__p", *(F.coalesce(F.sum(f"__t_{n}").over(every), F.lit(0)).alias(f"__t_{n}") for n in sums))
    return place.join(F.broadcast(whole), "__p").select(*df.columns, *((F.col(f"__b_{n}") + F.col(f"__t_{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, order: list[str], name: str, first: Column | int = 1) -> DataFrame:
    """``df`` with consecutive ids in the order of a natural key.

    Ids are a range partition's offset plus the place within it, so no task sees all rows.
    Places are written before offsets are summed, so both speak of the same partitions.
    """
    spread = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    place, _ = written(spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), "numbered")
    before = place.groupBy("__p").agg(F.max("__n").alias("__c"))
    offset = before.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.lit(first) if isinstance(first, int) else first
    return place.join(F.broadcast(offset.select("__p", "__o")), "__p").withColumn(name, (F.col("__o") + F.col("__n") - 1 + start).cast("bigint")).drop("__p", "__n", "__o")


def upsert_names(existing: DataFrame, names: DataFrame, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """``existing`` (id, name) with a new id for each name it lacks; ids go on from the largest, by name."""
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(existing.select(name), name, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    new = numbered(fresh, [name], id_col).join(F.broadcast(top)).select((F.col(id_col) + F.col("__top")).alias(id_col), name)
    return existing.select(id_col, name).unionByName(new)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet are added, once each."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def inserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added as they are, repeats included."""
    return existing.unionByName(new.select(*existing.columns))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold, unknown included."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def truncated(df: DataFrame) -> DataFrame:
    return df.limit(0)


def updated(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the non-null values of ``changes`` in place of its own, by key."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in fields))
    return df.join(new, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def cascade_delete(gone: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys in ``gone``."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def page(df: DataFrame, order: list[str], limit: int | None, offset: int = 0) -> DataFrame:
    """A page of the rows in order; no limit where it is None."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys asked for that are not there."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def embedding_counts(df: DataFrame, vector: str) -> DataFrame:
    """(total, embedded, waiting) rows."""
    has = F.col(vector).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("embedded"), F.count_if(~has).alias("waiting"))


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows first in the order of a seeded hash: a sample that reruns agree on."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def first_seen(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of several tables with each key's row of the first table that has it, and of the least row there."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    others = [c for c in every.columns if c not in (key, "__part")]
    best = every.groupBy(key).agg(F.min(F.struct("__part", *others)).alias("__b"))
    return best.select(key, *(F.col(f"__b.{c}").alias(c) for c in others))
