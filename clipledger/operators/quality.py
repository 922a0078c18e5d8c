"""Quality logs: parsing, pooling, worst frame, verdict with a second try."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.rules import round_half_up

# Acceptance limits.
MIN_VMAF = 95.0
MIN_PSNR = 42.0
MIN_SSIM = 0.97
MIN_WORST_PSNR = 45.0


def parse_quality_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Read ``psnr_avg`` and the overall SSIM from log lines; ``inf`` is allowed."""
    psnr = F.regexp_extract(column, r"psnr_avg:(-?inf|-?[0-9.]+)", 1)
    ssim = F.regexp_extract(column, r"All:(inf|[0-9.]+)", 1)
    return lines.withColumns({"psnr_avg": psnr.try_cast("double"), "ssim": ssim.try_cast("double")})


def pool_quality(log: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the per-frame values, with infinite PSNR as 100, minus infinity as 0, SSIM as 1.

    Values are added up as whole numbers of 1e-8, so means do not depend on how rows are spread. A
    key may have 900 million values.
    """
    psnr, ssim = F.col("psnr_avg"), F.col("ssim")
    exact = lambda c: F.round(c * 1e8).cast("bigint")
    psnr = F.when(psnr == float("inf"), 100.0).when(psnr == float("-inf"), 0.0).otherwise(psnr)
    ssim = F.when(ssim == float("inf"), 1.0).otherwise(ssim)
    mean = lambda c: F.sum(exact(c)).cast("double") / 1e8 / F.count(c)
    return log.groupBy(*keys).agg(
        F.count(psnr).alias("frames"),
        round_half_up(mean(psnr), 3).alias("psnr"),
        round_half_up(mean(ssim), 5).alias("ssim"),
    )


def worst_frame(log: DataFrame, min_db: float = MIN_WORST_PSNR) -> DataFrame:
    """Lowest frame PSNR per clip; a clip without any value fails."""
    return log.groupBy("clip_id").agg(F.min("psnr_avg").alias("worst_psnr")).withColumn(
        "pass", F.coalesce(F.col("worst_psnr") >= min_db, F.lit(False))
    )


def passes(vmaf: Column, psnr: Column, ssim: Column) -> Column:
    """VMAF decides where there is one, else PSNR and SSIM together."""
    pair = (psnr >= MIN_PSNR) & (ssim >= MIN_SSIM)
    return F.coalesce(F.when(vmaf.isNotNull(), vmaf >= MIN_VMAF).otherwise(pair), F.lit(False))


def quality_verdict(runs: DataFrame) -> DataFrame:
    """Final verdict per clip from ``clip_id, attempt, vmaf, psnr, ssim`` (attempt 2 = the retry).

    The first run decides when it passes; otherwise the retry does, if there was one.
    """
    scored = runs.withColumn("_pass", passes(F.col("vmaf"), F.col("psnr"), F.col("ssim")))
    run = F.struct("vmaf", "psnr", "ssim", F.col("_pass").alias("pass"))
    both = scored.groupBy("clip_id").agg(
        F.max(F.when(F.col("attempt") == 1, run)).alias("one"),
        F.max(F.when(F.col("attempt") == 2, run)).alias("two"),
    )
    retry = ~F.coalesce(F.col("one.pass"), F.lit(False))
    final = F.when(retry & F.col("two").isNotNull(), F.col("two")).otherwise(F.col("one"))
    return both.select(
        "clip_id",
        retry.alias("needs_retry"),
        (retry & F.col("two").isNotNull()).alias("retried"),
        final["vmaf"].alias("vmaf"),
        final["psnr"].alias("psnr"),
        final["ssim"].alias("ssim"),
        F.when(F.coalesce(final["pass"], F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"),
    )
