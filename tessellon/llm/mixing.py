"""Operator 10: mixing sources to target weights.

Tokens are summed per source, each source gets a target by weight and a repetition rate
from it, and each document is emitted floor(rate) times plus once more with the rate's
fraction as probability. The draw is a hash of a seed and the document's key, so reruns,
retries and other partitionings agree. Everything is built-in functions: documents are
pre-aggregated by source before the shuffle, and one row for each source goes back to
them, by broadcast only below a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.operators.tables import prefix_sums
from tessellon.session import written

WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: The plan is broadcast while it has no more rows and bytes of names than this; beyond it the join is shuffled.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than a space and the characters 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) of one row per source (source, source_size).

    Sources are ordered by code point with null last and take the weights in turn. A
    target that would pass ``most`` times its source stops there, and what is over goes
    to the others by weight until none is above. With sources in order of cap by weight
    the level at which that ends is found by sums over the sources before each: a source
    is full when the level with all before it full does not fall below its own. The sums
    are range-partitioned, so no task holds all sources.
    """
    ordered = prefix_sums(sizes, [F.col("source").isNull(), F.col("source")], {"n": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    placed = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    placed = prefix_sums(placed, [F.col("cap") / F.col("weight"), F.col("n")], {"full_before": F.col("cap"), "weight_before": F.col("weight")})
    placed, _ = written(placed, "mix-levels")
    whole = placed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    left = F.lit(float((whole["total"] or 0) * share)) - F.col("full_before")
    placed = placed.withColumn("level", left / (F.lit(float(whole["weights"] or 1)) - F.col("weight_before")))
    # the first source that its level does not fill sets the level for itself and all after it
    first = placed.where(F.col("level") * F.col("weight") < F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), "n", "level")).alias("open")).first()["open"]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first["level"]) * F.col("weight"))
    placed = placed.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return placed.select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_plan(rows: DataFrame, sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``rows`` with the columns of their source's plan, by broadcast while the sources are few and short."""
    plan, _ = written(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-plan")
    bound = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.coalesce("source", F.lit("")))), F.lit(0))).first()
    few = bound[0] <= BROADCAST_SOURCES and bound[1] <= BROADCAST_BYTES
    plan = F.broadcast(plan) if few else plan
    return rows.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))


def copies(key: Column, seed: str) -> Column:
    """Whole repetitions plus one drawn with the rate's fraction as probability."""
    return F.floor("rate").cast("bigint") + (draw(key, seed) < F.col("rate") - F.floor("rate")).cast("bigint")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(key, size, source_size, target, copies, taken) for every row.

    A null text has size 0, a null source is a source of its own, rows with a null key
    draw as one key, repeated rows draw alike, and an empty table gives no rows.
    """
    base, _ = written(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    out = with_plan(base, base, weights, share, most)
    return out.select(F.col("id").alias(key), "size", "source_size", "target", copies(F.col("id"), seed).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; its columns stay."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("source"))
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    out = with_plan(own, sizes, weights, share, most).select("row", copies(F.col("row")[key], seed).cast("int").alias("copies"))
    return out.where("copies > 0").select(F.explode(F.array_repeat(F.col("row"), F.col("copies"))).alias("row")).select("row.*")


#: DuckDB SQL for the rows of ``mix`` over ``documents`` with the settings above.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, (SELECT arg_min(level, (cap / weight, n)) FROM l WHERE level * weight < cap) AS open_level FROM l),
t AS (SELECT *, least(cap, coalesce(open_level * weight, cap)) AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(rate)::BIGINT + (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
