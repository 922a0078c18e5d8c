"""Archive checks: stream summary, rule table, source hash, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import rules as R
from clipledger.plans.scan import attach

# Fixed values.
CODEC = "hevc"
PIXEL_FORMAT = "yuv420p10le"
FULL_RANGE = ["pc", "jpeg"]
RATE_LOW, RATE_HIGH = 44_000, 52_000
HASH_KEYS = ["sha256", "sha_256", "sha-256", "hash"]
SOURCE_KEYS = ["input_file", "input_file_path", "source_file", "source", "filename"]
SIDECAR_KEYS = ["crf", "keyint", "matrix"]


def stream_summary(probe: DataFrame) -> DataFrame:
    """Stream counts and the attributes of the first video and first audio stream of each file."""
    video = F.filter("streams", lambda s: s["width"].isNotNull())
    audio = F.filter("streams", lambda s: s["sample_rate"].isNotNull())
    first = lambda c: F.get(c, F.lit(0))
    picked = ["codec_name", "profile", "pix_fmt", "color_space", "color_range", "width", "height"]
    return probe.select(
        "path",
        F.size(video).cast("bigint").alias("video_streams"),
        F.size(audio).cast("bigint").alias("audio_streams"),
        *[first(video)[c].alias(c) for c in picked],
        *[first(audio)[c].alias(c) for c in ("sample_rate", "channels")],
    )


def read_sidecar_text(sidecars: DataFrame) -> DataFrame:
    """What the checks need from ``path, text``: hash, key flags, decode path, device, gate."""
    return sidecars.select(
        "path",
        R.json_first("text", HASH_KEYS).alias("sha256"),
        *[
            F.col("text").rlike(rf'(?i)"{key}"').alias(f"has_{key}") for key in SIDECAR_KEYS
        ],
        R.json_first("text", ["decode_path"]).alias("decode_path"),
        R.json_first("text", ["gpu_device"]).alias("gpu_device"),
        R.json_has("text", "gate_psnr_db").alias("has_gate"),
    )


def verify_archives(streams: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row per file and rule: ``path, rule, status`` (pass / fail / info).

    ``streams`` comes from :func:`stream_summary`, ``sidecars`` from :func:`read_sidecar_text`.
    """
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    has_audio = c("audio_streams") >= 1
    has_sidecar = c("_sidecar").isNotNull()
    gpu = has_sidecar & yes(c("decode_path") == "gpu")
    rows: list[Column] = []

    def rule(name: str, ok: Column, applies: Column | None = None, absent: str | None = None):
        status = F.when(yes(ok), "pass").otherwise("fail")
        if applies is not None:
            status = F.when(applies, status).otherwise(F.lit(absent))
        rows.append(F.struct(F.lit(name).alias("rule"), status.alias("status")))

    rule("video stream", c("video_streams") >= 1)
    rule("codec", c("codec_name") == CODEC)
    rule("profile", c("profile").rlike("Main.*10"))
    rule("pixel format", c("pix_fmt") == PIXEL_FORMAT)
    rule("color space", c("color_space").startswith("bt2020"))
    rule("color range", c("color_range").isin(FULL_RANGE))
    rule("size", (c("width") > 0) & (c("height") > 0))
    rule("sample rate", c("sample_rate").between(RATE_LOW, RATE_HIGH), has_audio, "info")
    rule("channels", c("channels") >= 1, has_audio, "info")
    for key in SIDECAR_KEYS:
        rule(f"sidecar {key}", c(f"has_{key}"), has_sidecar, "info")
    rule("decode path", c("decode_path").isin("gpu", "cpu"), has_sidecar, "info")
    rule("gpu device", c("gpu_device").isNotNull(), gpu, "info")
    rule("gate value", c("has_gate"), gpu, "info")
    return (
        streams.join(sidecars.withColumn("_sidecar", F.lit(1)), "path", "left")
        .select("path", F.explode(F.array(*rows)).alias("r"))
        .select("path", "r.rule", "r.status")
    )


def verdict(rules: DataFrame) -> DataFrame:
    """A file passes when no rule failed."""
    return rules.groupBy("path").agg(
        F.count_if(F.col("status") == "fail").alias("failed_rules"),
        F.when(F.bool_and(F.col("status") != "fail"), "PASS").otherwise("FAIL").alias("verdict"),
    )


def _dir_and_name(folder_of: Column, name_of: Column) -> Column:
    folder = F.regexp_extract(folder_of, r"^(.*/)", 1)
    return F.concat(folder, F.regexp_extract(name_of, r"([^/]*)$", 1))


def verify_source_hash(sidecars: DataFrame, hashes: DataFrame) -> DataFrame:
    """Compare the hash in a sidecar with the hash of its source file.

    ``sidecars`` has ``path, sha256`` and any number of candidate columns in
    ``candidates ARRAY<STRING>`` (recorded source paths, best first); ``hashes`` has
    ``path, sha256`` of the files that exist. A recorded path that does not exist is tried as the
    same name next to the archive. Any match passes; files found but none equal fails.
    """
    known = hashes.select(F.col("path").alias("_name"), F.col("sha256").alias("_hash"))
    near = hashes.select(F.col("path").alias("_beside"), F.col("sha256").alias("_near_hash"))
    asked = (
        sidecars.filter("sha256 is not null")
        .select("path", F.col("sha256").alias("_want"), F.explode("candidates").alias("_name"))
        .filter("_name is not null")
        .withColumn("_beside", _dir_and_name(F.col("path"), F.col("_name")))
    )
    # Many archives may name one source, so both look-ups are spread by the archive's path.
    spread = F.pmod(F.xxhash64("path"), F.lit(256))
    tried = attach(attach(asked, known, ["_name"], spread), near, ["_beside"], spread).withColumn(
        "_got", F.coalesce("_hash", "_near_hash")
    )
    found = tried.groupBy("path").agg(
        F.count("_got").alias("_found"),
        F.count_if(F.col("_got") == F.col("_want")).alias("_equal"),
    )
    status = (
        F.when(F.col("sha256").isNull(), "no hash")
        .when(F.col("_equal") > 0, "pass")
        .when(F.col("_found") > 0, "fail")
        .otherwise("not found")
    )
    return sidecars.select("path", "sha256").join(found, "path", "left").select(
        "path", status.alias("status")
    )


def hash_rules(checked: DataFrame) -> DataFrame:
    """Source-hash results as rule rows; only a failed match fails an archive."""
    return checked.select(
        "path",
        F.lit("source hash").alias("rule"),
        F.when(F.col("status").isin("pass", "fail"), F.col("status")).otherwise("info").alias("status"),
    )
