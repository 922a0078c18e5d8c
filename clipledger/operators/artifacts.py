"""Files of an archive: what state each clip is in, what is left to do, how a run went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import rules as R
from clipledger.plans.scan import attach

# Suffix of each kind of file, longest first where one ends with another.
KINDS = {
    ".sidecar.json": "sidecar",
    ".part.old": "part_old",
    ".part": "part",
    ".samples": "samples",
    ".ckpt": "ckpt",
    ".h265.mov": "output",
    ".NEV": "source",
    ".nev": "source",
}


def kind_of(path: Column) -> Column:
    out = None
    for suffix, kind in KINDS.items():
        hit = path.endswith(suffix)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def clip_key(path: Column) -> Column:
    """The output a file belongs to: side files lose their suffix, sources map to their output."""
    kind = kind_of(path)
    bare = F.regexp_replace(path, r"\.(sidecar\.json|part\.old|part|samples|ckpt)$", "")
    return F.when(kind == "source", R.default_output(path)).otherwise(bare)


def classify(files: DataFrame) -> DataFrame:
    """Add ``kind`` and ``clip_key`` to a table with ``path``; other files get a null kind."""
    return files.withColumns({"kind": kind_of(F.col("path")), "clip_key": clip_key(F.col("path"))})


def match_checkpoints(checkpoints: DataFrame, now: DataFrame) -> DataFrame:
    """Does a checkpoint fit the present run? One row per checkpoint with the first rule it breaks.

    ``now`` has ``clip_key, tool_version, input, sha256, settings_hash``. A checkpoint without a
    source hash fits but is ``unverified``.
    """
    mine = now.select(
        "clip_key",
        F.col("tool_version").alias("_tool"),
        F.col("input").alias("_input"),
        F.col("sha256").alias("_sha"),
        F.col("settings_hash").alias("_settings"),
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    no_hash = F.coalesce("sourceSha256", F.lit("")) == ""
    status = (
        F.when(F.col("_tool").isNull() & F.col("_settings").isNull(), "no source")
        .when(~same("toolVersion", "_tool"), "other version")
        .when(~same("input", "_input"), "other input")
        .when(~no_hash & ~same("sourceSha256", "_sha"), "source changed")
        .when(~same("settingsHash", "_settings"), "other settings")
        .when(no_hash & (F.coalesce("_sha", F.lit("")) != ""), "unverified")
        .otherwise("match")
    )
    return checkpoints.join(mine, "clip_key", "left").select(
        "clip_key", status.alias("status"), status.isin("match", "unverified").alias("usable")
    )


def artifact_state(
    artifacts: DataFrame, matches: DataFrame, progress: DataFrame | None = None
) -> DataFrame:
    """State of each clip from the files it has: FRESH, REJECT, RESUMABLE or ROLL_BACK.

    ``matches`` (``clip_key, usable``) says whether the checkpoint is valid and fits; ``progress``
    (``clip_key, resume_frame``) adds the resume point, 0 meaning that the part holds nothing of
    use. Checkpoints without files show up too.
    """
    has = lambda kind: F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))
    files = artifacts.groupBy("clip_key").agg(
        *[has(k).alias(f"has_{k}") for k in ("part", "part_old", "samples", "ckpt")]
    )
    joined = files.join(matches.select("clip_key", "usable"), "clip_key", "full")
    frames = F.lit(1)
    if progress is not None:
        joined = joined.join(progress.select("clip_key", "resume_frame"), "clip_key", "left")
        frames = F.coalesce("resume_frame", F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    valid = flag("has_samples") & flag("has_ckpt") & flag("usable")
    state = (
        F.when(~flag("has_part") & flag("has_part_old"), "ROLL_BACK")
        .when(~flag("has_part"), "FRESH")
        .when(~valid, "REJECT")
        .when(frames > 0, "RESUMABLE")
        .when(flag("has_part_old"), "ROLL_BACK")
        .otherwise("FRESH")
    )
    return joined.select(
        "clip_key",
        *[flag(f"has_{k}").alias(f"has_{k}") for k in ("part", "part_old", "samples", "ckpt")],
        state.alias("state"),
    )


def source_status(sources: DataFrame, artifacts: DataFrame, force: bool = False) -> DataFrame:
    """Why each source is or is not to be processed.

    ``sources`` has ``path, is_regular``. A source is done when its output and the sidecar exist.
    Names that many sources share are spread by the source path.
    """
    present = (
        artifacts.filter(F.col("kind").isin("output", "sidecar"))
        .groupBy("clip_key")
        .agg(
            F.bool_or(F.col("kind") == "output").alias("has_output"),
            F.bool_or(F.col("kind") == "sidecar").alias("has_sidecar"),
        )
    )
    wanted = sources.withColumn("clip_key", R.default_output("path"))
    known = attach(wanted, present, ["clip_key"], F.pmod(F.xxhash64("path"), F.lit(256)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~flag("is_regular"), "not a file").when(~flag("has_output"), "new")
    if force:
        reason = reason.otherwise("forced")
    else:
        reason = reason.when(flag("has_sidecar"), "done").otherwise("no sidecar")
    return known.select("path", "clip_key", reason.alias("reason"))


def pending(sources: DataFrame, artifacts: DataFrame, force: bool = False) -> DataFrame:
    """The sources still to be processed, with the reason."""
    return source_status(sources, artifacts, force).filter(
        ~F.col("reason").isin("not a file", "done")
    )


def name_collisions(sources: DataFrame) -> DataFrame:
    """Outputs that more than one source maps to. Counted on the map side, no list is collected."""
    return (
        sources.select(R.default_output("path").alias("clip_key"), "path")
        .groupBy("clip_key")
        .agg(
            F.count("*").alias("sources"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
        )
        .filter("sources > 1")
    )


def batch_summary(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ok / failed / skipped / total and elapsed seconds; other items count in the total only."""
    seconds = lambda c: F.unix_timestamp(c)
    return runs.groupBy(*(keys or [])).agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.count("*").alias("total"),
        (seconds(F.max("ended")) - seconds(F.min("started"))).alias("elapsed_s"),
    )
