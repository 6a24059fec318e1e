"""Seeded synthetic entities, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Ada", "Bela", "Chen", "Dara", "Elif", "Femi", "Gita", "Hugo", "Ines", "Jun")
LAST = ("Abadi", "Brandt", "Costa", "Dubois", "Eze", "Fischer", "Garcia", "Haddad", "Ito", "Jansen")
TRADE = ("Steel", "Foods", "Energy", "Systems", "Textiles", "Optics", "Logistics", "Media")
PLACE = ("North", "South", "East", "West", "Upper", "Lower", "New", "Old")


def _pick(values: tuple[str, ...], salt: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def synthetic_entities(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(entity_id, entity_name, entity_type): n distinct names; 40 % persons, 30 % companies, 20 % organisations, 10 % places."""
    share = F.pmod(F.xxhash64("id", F.lit("type"), F.lit(seed)), F.lit(10))
    kind = F.when(share < 4, "person").when(share < 7, "company").when(share < 9, "organization").otherwise("location")
    first, last, trade, place = (_pick(v, s, seed) for v, s in ((FIRST, "f"), (LAST, "l"), (TRADE, "t"), (PLACE, "p")))
    name = F.when(kind == "person", F.concat_ws(" ", first, last)).when(kind == "company", F.concat_ws(" ", last, trade)).when(kind == "organization", F.concat_ws(" ", place, trade, F.lit("Institute"))).otherwise(F.concat_ws(" ", place, last))
    return spark.range(1, n + 1).select(F.col("id").alias("entity_id"), F.concat(name, F.lit(" #"), F.col("id")).alias("entity_name"), kind.alias("entity_type"))


def similar_entities(spark: SparkSession, n: int) -> DataFrame:
    """(entity_id, entity_name, family): names that vary one of 15 families in five ways, in turn."""
    base = [f"{LAST[i % 10]} {TRADE[i % 8]}" for i in range(15)]
    forms = ("{}", "{} Inc", "{} Corporation", "The {} Group", "{} Ltd")
    names = F.array(*(F.lit(f.format(b)) for b in base for f in forms))
    place = F.pmod(F.col("id") - 1, F.lit(75)).cast("int")
    return spark.range(1, n + 1).select(F.col("id").alias("entity_id"), F.concat(F.element_at(names, place + 1), F.lit(" #"), F.col("id")).alias("entity_name"), F.floor(place / 5).cast("int").alias("family"))
