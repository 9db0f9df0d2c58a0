"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the budget over its size. Each document draws its number of copies
from a Poisson distribution of that mean, by inversion at a number hashed from its id; the copies are then spread over
all tasks and ordered by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.hashing import hash52
from shelfwise.llm.names import named, numbered, of
from shelfwise.llm.storage import stored

#: Seed of the draws and of the order.
SEED = 29
#: Copies of a document made by one step.
COPIES = 1 << 12
#: Means from here on are inverted around the mean, not from zero.
LARGE = 400.0


def _log_factorial(k: Column) -> Column:
    """ln k! for k of 100 and more (Stirling's series)."""
    z = k.cast("double") + 1.0
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)


def distributions(rates: DataFrame) -> DataFrame:
    """``rates`` (source, rate) with ``first`` and ``cdf``: cdf[i] is P(X <= first + i).

    It covers twelve standard deviations on both sides, which leaves nothing that a double could hold."""
    spread = 12 * F.sqrt("rate") + 30
    ranged = rates.select(
        "source", "rate",
        F.when(F.col("rate") < LARGE, F.lit(0)).otherwise(F.floor(F.col("rate") - spread)).cast("long").alias("first"),
        F.ceil(F.col("rate") + spread).cast("long").alias("last"),
    )
    counts = ranged.withColumn("k", F.explode(F.sequence("first", "last")))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("first") == 0, F.lit(0.0)).otherwise(_log_factorial(F.col("first")))
    step = F.when(F.col("k") > F.col("first"), F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).otherwise(0.0)
    logged = counts.withColumn("lf", start + F.sum(step).over(upto))
    part = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("lf"))
    summed = logged.withColumn("p", part).withColumn("c", F.sum("p").over(upto))
    return (
        summed.groupBy("source").agg(F.first("first").alias("first"), F.array_sort(F.collect_list("c")).alias("cdf"), F.first("rate").alias("rate"))
    )


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): how often each source's documents shall appear on average.

    A source's size is its characters, at least one for a document; the budget is ``epochs`` times the size of all.
    ``weights`` names the sources wanted, in proportion; without it all sources weigh the same. A null source is one of its own."""
    sizes = stored(docs.groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("size")))
    total, sources = sizes.agg(F.sum("size"), F.count("*")).first()
    if weights is None:
        share = F.lit(1.0) / max(1, sources)
    else:
        whole = sum(weights.values())
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(name), weight / whole).otherwise(share)
    rates = sizes.select("source", (F.lit(float(epochs)) * share * float(total or 0) / F.col("size")).alias("rate"))
    return rates.where("rate > 0")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The copies: all columns of ``docs``, with ``copy`` (from 1) and ``shuffle_key``, spread over all tasks by that key and
    ordered by it inside each.

    ``docs`` needs doc_id, text and source. Documents may get no copy. Rows with equal ids draw alike, nulls too. Columns named
    copy or shuffle_key, in any case, are replaced. An empty table stays empty.
    """
    doc_id = of(docs, "doc_id")
    laws = distributions(target_rates(docs, weights, epochs)).select("source", "first", "cdf")
    drawn = numbered(docs).join(laws, of(docs, "source").eqNullSafe(F.col("source")))
    unit = (hash52(F.lit(seed), doc_id).cast("double") + 0.5) / float(1 << 52)
    drawn = drawn.withColumn("unit", unit)
    times = F.col("first") + F.size(F.filter("cdf", lambda c: c <= F.col("unit")))
    drawn = drawn.withColumn("times", times).where("times > 0").drop("source", "first", "cdf", "unit")
    # a document with very many copies is laid out range by range
    ranges = drawn.withColumn("begin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(COPIES).cast("long"))))
    rows = ranges.withColumn("copy", F.explode(F.sequence("begin", F.least(F.col("begin") + (COPIES - 1), F.col("times")))))
    rows = rows.withColumn("shuffle_key", hash52(F.lit(seed), F.lit("order"), doc_id, F.col("copy")))
    rows = rows.drop("times", "begin").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return rows.select(*named(docs, ("copy", "shuffle_key")), "copy", "shuffle_key")


MIX_SQL = f"""
WITH sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, (1.0 / (SELECT count(*) FROM sizes)) * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate FROM sizes),
ranged AS (
  SELECT source, rate, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT AS last FROM rates),
counts AS (SELECT source, rate, unnest(range(0, last + 1)) AS k FROM ranged),
logged AS (
  SELECT *, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf FROM counts),
summed AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM logged),
laws AS (SELECT source, list(c ORDER BY k) AS cdf FROM summed GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cdf, lambda c: c <= (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52})) AS times
  FROM documents d JOIN laws ON d.source IS NOT DISTINCT FROM laws.source),
copies AS (SELECT * EXCLUDE (times), unnest(range(1, times + 1)) AS copy FROM drawn WHERE times > 0)
SELECT *, ('0x' || substr(md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM copies
"""
