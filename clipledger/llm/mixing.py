"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.session import store

SEED = "mix-1"
TEMPERATURE = 0.5
# A Poisson count with a larger mean is the sum of independent ones with at most this mean.
MEAN_STEP = 8.0
# Terms of one inverted distribution: P(more than 63 | mean 8) is below 1e-34.
TERMS = 64
# Sources whose rates (TERMS doubles each) are broadcast, at most: 5 MB.
FEW_SOURCES = 10_000
UNIT_DIGITS = 13


def unit(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from a seeded hash; 52 bits, exact in double."""
    key = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(key, 1, UNIT_DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(
        float(1 << (4 * UNIT_DIGITS))
    )


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """Per source (``_mix_source``): mean repetition ``rate`` and the ``cdf`` of one Poisson step.

    Weights not given follow rows ** TEMPERATURE, which lifts small sources and lowers a source
    that holds a third of everything. Sources missing from given ``weights`` get weight 0.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(TEMPERATURE))
    else:
        # Only their ratios count, so the greatest becomes 1e9 and no small one is rounded away.
        top = max([*weights.values(), 0.0]) or 1.0
        named = F.create_map(*[F.lit(x) for source, w in weights.items() for x in (source, 1e9 * w / top)])
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    weighted = sizes.withColumn("_w", weight.cast("decimal(30,9)"))
    sums = weighted.agg(
        F.sum("_w").cast("double").alias("w"),
        F.sum("_n").cast("double").alias("n"),
        F.count(F.lit(1)).alias("sources"),
    ).first()
    wanted = F.lit(sums.n if total is None else float(total))
    rate = wanted * F.col("_w").cast("double") / F.lit(sums.w) / F.col("_n") if sums.w else F.lit(0.0)
    mean = F.col("rate") / F.col("steps")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        # p(k) = p(k - 1) * mean / k, summed up.
        p = acc["p"] * mean / k.cast("double")
        return F.struct(
            p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf")
        )

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["cdf"])
    rated = (
        weighted.select(F.col("source").alias("_mix_source"), rate.alias("rate"))
        .withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int"))
        .withColumn("cdf", cdf)
    )
    # Few sources go to every task, so documents need no shuffle to meet their rate. Many are
    # a table of their own, and the join can split the documents of a frequent one.
    return F.broadcast(rated) if sums.sources <= FEW_SOURCES else store(rated, "mix-rates")


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED
) -> DataFrame:
    """Every row of ``docs`` repeated by a Poisson count, then shuffled over all rows.

    The mean of the count is the target repetition rate of the row's source. The count inverts
    the distribution at a hash of seed and doc_id, so it is the same wherever and however often
    the row is read; adding sources or rows changes rates only. Returns the columns of ``docs``
    plus ``rate``, ``copy`` (from 0) and ``shuffle_key`` (the rows' order).

    A null source is a source of its own. A row without a doc_id is drawn by its text, so rows
    without one have counts of their own; repeated doc_ids, and repeated rows, get the same count. Null texts are carried along. A weight of 0 drops a source,
    an empty table gives an empty result. Columns of ``docs`` named like the added ones, or
    starting with ``_mix_``, are replaced.
    """
    docs = docs.drop("rate", "copy", "shuffle_key")
    per_source = rates(docs, weights, total)
    unnamed = F.concat(F.lit("/"), F.sha2(F.concat_ws("/", F.col("text").isNull().cast("string"), "text"), 256))
    key = F.coalesce(F.col("doc_id").cast("string"), unnamed)
    placed = docs.withColumn("_mix_at", F.monotonically_increasing_id())
    joined = placed.join(per_source, F.col("source").eqNullSafe(F.col("_mix_source")))
    units = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda i: unit(seed, i.cast("string"), key))
    count = F.aggregate(
        units, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u))
    )
    copies = joined.withColumn("_mix_count", count).filter("_mix_count > 0")
    exploded = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mix_count") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("copy").cast("string"), key))
    return (
        exploded.withColumn("shuffle_key", order)
        .drop("_mix_source", "_mix_count", "steps", "cdf")
        # Equal keys (repeated or null doc_ids) may lie in several ranges.
        .repartitionByRange("shuffle_key", "_mix_at")
        .sortWithinPartitions("shuffle_key", "_mix_at")
        .drop("_mix_at")
    )
