"""Clip facts and encode settings: defaults, limits, overrides, fingerprints, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import rules as R

# Allowed range of each option.
OPTION_RANGES = {
    "kelvin": (0, 100_000),
    "tint": (-100, 100),
    "iso": (0, 10_000_000),
    "exposure": (-100, 100),
    "crf": (0, 51),
    "keyint": (0, 1_000_000),
    "min_keyint": (1, 1_000_000),
    "pools": (0, 1024),
    "cpu_workers": (1, 256),
    "jobs": (1, 4096),
    "buffers": (1, 4096),
    "open_gop": (0, 1),
}
MAX_FRAMES_LIMIT = 1_000_000_000
# Fixed value: the parts of the settings fingerprint, in order. Options that change only the speed
# are not part of it.
FINGERPRINT = (
    ("decode", "decode_mode"),
    ("kelvin", "kelvin"),
    ("tint", "tint"),
    ("iso", "iso"),
    ("exposure", "exposure"),
    ("lens", "lens"),
    ("chromaNr", "chroma_nr"),
    ("crf", "crf"),
    ("preset", "preset"),
    ("keyint", "keyint"),
    ("minKeyint", "min_keyint"),
    ("openGop", "open_gop"),
    ("buffers", "buffers"),
    ("faststart", "faststart"),
    ("noAudio", "no_audio"),
    ("maxFrames", "max_frames"),
)
# The "as shot" markers of whole numbers.
AS_SHOT = {"kelvin": "0", "iso": "0", "chroma_nr": "-1"}


def normalize_fps(df: DataFrame) -> DataFrame:
    """``fps_num, fps_den`` from the recorded rate, else the container rate.

    A missing denominator and any 0 become 1. ``fps_reject`` marks absurd rates.
    """
    recorded = F.col("record_num").isNotNull()
    num = F.coalesce(F.when(recorded, F.col("record_num")).otherwise(F.col("container_num")), F.lit(0))
    den = F.coalesce(
        F.when(recorded, F.col("record_den")).otherwise(F.col("container_den")), F.lit(1)
    )
    one = lambda c: F.when(c == 0, 1).otherwise(c).cast("bigint")
    return df.withColumns({"fps_num": one(num), "fps_den": one(den)}).withColumn(
        "fps_reject", (F.col("fps_den") > R.MAX_FPS_DEN) | (F.col("fps_num") > R.MAX_FPS_NUM)
    )


def check_audio(df: DataFrame) -> DataFrame:
    """Is there audio, at which rate, and is its depth one we can take?"""
    present = (F.col("channels") > 0) & (F.col("block_count") > 0)
    rate = F.col("sample_rate")
    usable = (rate > 0) & (rate <= R.MAX_SAMPLE_RATE)
    return df.withColumns(
        {
            "audio_present": F.coalesce(present, F.lit(False)),
            "sample_rate": F.when(present, F.when(usable, rate).otherwise(R.DEFAULT_SAMPLE_RATE))
            .otherwise(rate)
            .cast("bigint"),
            "audio_reject": F.coalesce(
                present & ~F.col("bits").eqNullSafe(R.AUDIO_BITS), F.lit(False)
            ),
        }
    )


def clean_sentinels(settings: DataFrame) -> DataFrame:
    """Turn the "as shot" markers (0, NaN, -1) into nulls."""
    no_nan = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    return settings.withColumns(
        {
            "kelvin": F.nullif(F.col("kelvin"), F.lit(0)),
            "iso": F.nullif(F.col("iso"), F.lit(0)),
            "tint": no_nan("tint"),
            "exposure": no_nan("exposure"),
            "chroma_nr": F.nullif(F.col("chroma_nr"), F.lit(-1)),
        }
    )


def apply_overrides(shot: DataFrame, settings: DataFrame) -> DataFrame:
    """Values in force: the user's, or the camera's where the user left them as shot.

    ``lens`` is 1 on, 2 off; 0 keeps the camera's choice.
    """
    wanted = clean_sentinels(settings).select(
        "clip_id",
        *[
            F.col(c).alias(f"_{c}")
            for c in ("kelvin", "tint", "iso", "exposure", "lens", "chroma_nr")
        ],
    )
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    return shot.join(wanted, "clip_id", "left").select(
        "clip_id",
        *[pick(c) for c in ("kelvin", "tint", "iso", "exposure", "chroma_nr")],
        F.coalesce(F.nullif(F.col("_lens"), F.lit(0)), F.col("lens")).alias("lens"),
    )


def validate_settings(settings: DataFrame) -> DataFrame:
    """One row per broken rule: ``clip_id, rule, value``. Options that are absent or null pass."""
    checks: list[Column] = []

    def broken(name: str, condition: Column, value: Column) -> None:
        hit = F.struct(
            F.lit(name).alias("rule"), value.cast("double").alias("value")
        )
        checks.append(F.when(F.coalesce(condition, F.lit(False)), hit))

    for option, (low, high) in OPTION_RANGES.items():
        if option in settings.columns:
            value = F.col(option)
            broken(option, (value < low) | (value > high) | F.isnan(value.cast("double")), value)
    if "max_frames" in settings.columns:
        frames = F.col("max_frames")
        broken(
            "max_frames", (frames == 0) | (frames < -1) | (frames > MAX_FRAMES_LIMIT), frames
        )
    if {"keyint", "min_keyint"} <= set(settings.columns):
        keyint, least = F.col("keyint"), F.col("min_keyint")
        broken("min_keyint above keyint", (keyint > 0) & (least > keyint), least)
    hits = F.filter(F.array(*checks), lambda hit: hit.isNotNull())
    return settings.select("clip_id", F.explode(hits).alias("hit")).select(
        "clip_id", "hit.rule", "hit.value"
    )


def settings_text(settings: DataFrame) -> Column:
    """The text behind the fingerprint. Reals print with six places, missing ones as ``nan``.

    Whole numbers that :func:`clean_sentinels` made null print their marker, so that raw and cleaned
    settings have the same fingerprint.
    """
    types = dict(settings.dtypes)

    def part(label: str, column: str) -> Column:
        value = F.col(column)
        if types[column] in ("float", "double"):
            text = (
                F.when(value.isNull() | F.isnan(value), "nan")
                .when(value == float("inf"), "inf")
                .when(value == float("-inf"), "-inf")
                .otherwise(F.format_string("%.6f", value.cast("double")))
            )
        elif types[column] == "boolean":
            text = F.when(value, "1").otherwise("0")
        else:
            text = F.coalesce(value.cast("string"), F.lit(AS_SHOT.get(column, "")))
        return F.concat(F.lit(f"{label}="), text)

    return F.concat_ws("|", *[part(*pair) for pair in FINGERPRINT])


def settings_hash(settings: DataFrame) -> DataFrame:
    return settings.withColumn("settings_hash", F.sha2(settings_text(settings), 256))


def cap_frames(frames: DataFrame, limit: int) -> DataFrame:
    """Keep the frames below ``limit`` (-1 = all) and below the clip's frame count."""
    kept = frames.filter("frame_no < frame_count")
    return kept if limit < 0 else kept.filter(F.col("frame_no") < limit)


def progress(df: DataFrame) -> DataFrame:
    """Progress figures from ``done, total, fps_num, fps_den, fps, now_epoch``.

    Time left is remaining frames over speed, and only given when the speed is above 0.01.
    """
    done, total = F.col("done").cast("double"), F.col("total").cast("double")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double")).otherwise(1.0)
    tick = lambda n: n * positive("fps_den") / positive("fps_num")
    fraction = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(0.0)
    left = F.when(F.col("fps") > 0.01, (total - done) / F.col("fps")).otherwise(0.0)
    filled = F.floor(fraction * 20 + 0.5).cast("int")
    return df.withColumns(
        {
            "fraction": fraction,
            "bar": F.rpad(F.repeat(F.lit("#"), filled), 20, "-"),
            "media_done_s": tick(done),
            "media_total_s": tick(total),
            "media_left_s": tick(total) - tick(done),
            "work_left_s": left,
            "eta_epoch": F.col("now_epoch") + left,
        }
    ).withColumns(
        {
            "done_text": R.fmt_duration("media_done_s"),
            "total_text": R.fmt_duration("media_total_s"),
            "left_text": R.fmt_duration("work_left_s"),
            "media_left_text": R.fmt_duration("media_left_s"),
        }
    )
