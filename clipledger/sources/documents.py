"""JSON side files and text logs: checkpoints, sidecars, quality logs, failure logs."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from clipledger.functions import rules as R
from clipledger.operators.arrivals import tail_n
from clipledger.operators.quality import parse_quality_log
from clipledger.schemas import CHECKPOINT, SIDECAR
from clipledger.session import reading_tasks, store
from clipledger.sources.files import known, open_file, resolve, settle
from clipledger.sources.listing import list_visible

# The fields a checkpoint must have.
REQUIRED_IN_CHECKPOINT = (
    "version",
    "toolVersion",
    "sourceSha256",
    "settingsHash",
    "videoFrames",
    "audioEndSample",
    "totalFrames",
)
FAILURE_TAIL = 5
# Files a task has open before it names them.
STAGED = 256
# Texts of the sidecar.
COLOR_SPACE = "RWG/Log3G10 (native, Primary_Development_Only)"
MATRIX = "BT.2020 full range"
CODEC = "hevc main10"
DEFAULT_POOLS = 8


def _plain_path() -> Column:
    """The path of a row's file as it is listed: Spark encodes it like an address."""
    plain = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    # url_decode reads a plus sign as a blank.
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


# Bytes of text that a task sends at once, and files at most.
_SENT_BYTES, _SENT_FILES = 8 << 20, 4096
_TEXTS = pa.schema([("path", pa.string()), ("text", pa.string())])


def _texts_of(batches):
    paths, texts, held = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as handle:
                # As Spark reads bytes that are no UTF-8.
                text = handle.read().decode("utf-8", "replace")
            paths.append(path)
            texts.append(text)
            held += len(text)
            if held >= _SENT_BYTES or len(paths) >= _SENT_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], schema=_TEXTS)
                paths, texts, held = [], [], 0
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], schema=_TEXTS)


def read_texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``path, text`` of the whole files below ``path`` whose names end so.

    Files are listed by tasks and dealt over tasks by their paths: millions of small ones cost neither
    a list on the driver nor a task for every few. Spark's own source reads stores that Arrow does not know.
    """
    if known(path):
        found = list_visible(spark, path, suffix).select("path")
        return found.repartition(reading_tasks(spark), "path").mapInArrow(_texts_of, "path string, text string")
    return (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(_plain_path().alias("path"), F.col("value").alias("text"))
    )


def _without(suffix: str) -> Column:
    return F.expr(f"substring(path, 1, length(path) - {len(suffix)})")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint files with ``clip_key`` and ``is_valid``: every field but ``input`` is needed."""
    texts = read_texts(spark, path, ".ckpt")
    lines = texts.select(
        _without(".ckpt").alias("clip_key"), F.explode(F.split("text", r"\r\n|\r|\n")).alias("text")
    )
    rows = parse_checkpoints(lines.filter(r"text rlike '[^\\x00-\\x20]'"))
    return rows.select(*[c for c in rows.columns if c not in ("clip_key", "is_valid")], "clip_key", "is_valid")


def _with_validity(rows: DataFrame) -> DataFrame:
    valid = F.col("_corrupt_record").isNull()
    for name in REQUIRED_IN_CHECKPOINT:
        valid = valid & F.col(name).isNotNull()
    return rows.withColumn("is_valid", valid).drop("_corrupt_record")


def parse_checkpoints(texts: DataFrame, column: str = "text") -> DataFrame:
    """The same for a table of checkpoint texts."""
    parsed = F.from_json(
        column, f"{CHECKPOINT}, _corrupt_record string", {"mode": "PERMISSIVE"}
    )
    rest = [c for c in texts.columns if c != column]
    return _with_validity(texts.select(*rest, parsed.alias("c")).select(*rest, "c.*"))


def latest_checkpoints(snapshots: DataFrame, order: str) -> DataFrame:
    """The newest snapshot of each clip; a clip with many snapshots is reduced before the shuffle."""
    rest = [c for c in snapshots.columns if c != "clip_key"]
    return (
        snapshots.groupBy("clip_key")
        .agg(F.max_by(F.struct(*rest), order).alias("s"))
        .select("clip_key", "s.*")
    )


def checkpoint_json(df: DataFrame) -> Column:
    fields = [part.split()[0] for part in CHECKPOINT.split(", ")]
    filled = [
        F.coalesce(F.col(f), F.lit("")).alias(f) if dict(df.dtypes)[f] == "string" else F.col(f)
        for f in fields
    ]
    return F.to_json(F.struct(*filled), {"ignoreNullFields": "false"})


def checkpoint_versions(path: str) -> list[int]:
    """Finished versions below ``path``; a version without its success mark is not there yet."""
    system, root = resolve(path)
    found = []
    for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        match = re.fullmatch(r"version=(\d+)", entry.base_name)
        if match and system.get_file_info(f"{entry.path}/_SUCCESS").type == fs.FileType.File:
            found.append(int(match.group(1)))
    return sorted(found)


def write_checkpoints(
    snapshots: DataFrame, path: str, order: str, version: int | None = None
) -> int:
    """Put the newest snapshot of each clip in place of its older one, as a new version.

    Clips without a new snapshot keep the one they have. Readers see whole versions only, and
    writing a version again gives the same table.
    """
    spark = snapshots.sparkSession
    versions = checkpoint_versions(path)
    if version is None:
        version = max(versions, default=-1) + 1
    latest = latest_checkpoints(snapshots, order)
    table = latest.select("clip_key", checkpoint_json(latest).alias("text"))
    earlier = [v for v in versions if v < version]
    if earlier:
        kept = _checkpoint_texts(spark, path, earlier[-1])
        table = table.union(kept.join(latest.select("clip_key"), "clip_key", "left_anti"))
    table.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def checkpoint_sink(path: str, order: str, keep: int = 3):
    """For ``foreachBatch``: each micro-batch of snapshots becomes a version of the table.

    Versions go on from the newest one, whichever query wrote it. A repeated batch is always the
    last one, and putting it on its own outcome gives the same table. Only the ``keep`` newest
    versions stay, for readers that began before the last batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_checkpoints(batch, path, order)
        drop_versions(path, keep)

    return write


def drop_versions(path: str, keep: int) -> None:
    """Remove all finished versions of a checkpoint table but the ``keep`` newest."""
    system, root = resolve(path)
    for version in checkpoint_versions(path)[: -max(keep, 1)]:
        system.delete_dir(f"{root}/version={version}")


def _checkpoint_texts(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("clip_key string, text string").parquet(f"{path}/version={version}")


def read_checkpoint_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a checkpoint table."""
    versions = checkpoint_versions(path)
    if not versions:
        raise FileNotFoundError(f"no finished checkpoint version below {path}")
    return parse_checkpoints(_checkpoint_texts(spark, path, versions[-1]))


# Buckets of a checkpoint table. A version names the folder of each, so its list is of this size.
BUCKETS = 256


def _bucket_versions(path: str) -> list[int]:
    system, root = resolve(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    names = (re.fullmatch(r"(\d+)\.json", f.base_name) for f in found)
    return sorted(int(n.group(1)) for n in names if n)


def _bucket_folders(path: str, version: int) -> dict[str, str]:
    system, root = resolve(path)
    with system.open_input_file(f"{root}/versions/{version}.json") as handle:
        return json.loads(handle.read())


def _bucket_texts(spark: SparkSession, path: str, folders: dict[str, str]) -> DataFrame:
    schema = "clip_key string, text string"
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders.values()))


def write_checkpoint_buckets(
    snapshots: DataFrame, path: str, order: str, version: int | None = None, buckets: int = BUCKETS
) -> int:
    """As :func:`write_checkpoints`, with only the buckets written anew that have a snapshot.

    Clips fall into ``buckets`` by hash. A version is a small file that names the folder of each
    bucket: those without a snapshot keep the folder they have, so the bytes of a version follow the
    clips it changes and not all clips. The file is written last, by the driver; readers see whole
    versions only, and writing a version again gives the same table. ``buckets`` must stay the same.
    """
    spark = snapshots.sparkSession
    versions = _bucket_versions(path)
    if version is None:
        version = max(versions, default=-1) + 1
    earlier = [v for v in versions if v < version]
    before = _bucket_folders(path, earlier[-1]) if earlier else {}
    bucket = F.pmod(F.xxhash64("clip_key"), F.lit(buckets)).cast("int")
    latest = latest_checkpoints(snapshots, order)
    fresh = store(latest.select("clip_key", checkpoint_json(latest).alias("text"), bucket.alias("bucket")), "snapshots")
    # At most as many rows as there are buckets.
    changed = [str(r.bucket) for r in fresh.select("bucket").distinct().collect()]
    kept = _bucket_texts(spark, path, {b: before[b] for b in changed if b in before})
    rows = fresh.unionByName(
        kept.join(fresh.select("clip_key"), "clip_key", "left_anti").withColumn("bucket", bucket)
    )
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    folders = {**before, **{b: f"{folder}/bucket={b}" for b in changed}}
    system, root = resolve(path)
    system.create_dir(f"{root}/versions", recursive=True)
    with system.open_output_stream(f"{root}/versions/{version}.new") as out:
        out.write(json.dumps(folders, sort_keys=True).encode())
    system.move(f"{root}/versions/{version}.new", f"{root}/versions/{version}.json")
    return version


def read_checkpoint_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table of :func:`write_checkpoint_buckets`."""
    versions = _bucket_versions(path)
    if not versions:
        raise FileNotFoundError(f"no finished checkpoint version below {path}")
    return parse_checkpoints(_bucket_texts(spark, path, _bucket_folders(path, versions[-1])))


def checkpoint_bucket_sink(path: str, order: str, keep: int = 3):
    """For ``foreachBatch``: each micro-batch of snapshots becomes a version; the ``keep`` newest stay.

    A repeated batch is always the last one, and putting it on its own outcome gives the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_checkpoint_buckets(batch, path, order)
        drop_bucket_versions(path, keep)

    return write


def drop_bucket_versions(path: str, keep: int) -> None:
    """Remove all versions but the ``keep`` newest, and the folders that none of these names."""
    system, root = resolve(path)
    versions = _bucket_versions(path)
    held, old = versions[-max(keep, 1) :], versions[: -max(keep, 1)]
    used = {f for v in held for f in _bucket_folders(path, v).values()}
    gone = {f for v in old for f in _bucket_folders(path, v).values()} - used
    for version in old:
        system.delete_file(f"{root}/versions/{version}.json")
    for folder in gone:
        system.delete_dir(f"{root}/{folder}")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files with the path of the output they belong to."""
    texts = read_texts(spark, path, ".sidecar.json").filter(r"text rlike '[^\\x00-\\x20]'")
    parsed = texts.select(
        F.from_json("text", SIDECAR, {"mode": "PERMISSIVE"}).alias("c"), _without(".sidecar.json").alias("clip_key")
    )
    return parsed.select("c.*", "clip_key")


def read_sidecar_files(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars as ``path, text`` (path of the output), for checks that look at any key."""
    return read_texts(spark, path, ".sidecar.json").select(_without(".sidecar.json").alias("path"), "text")


def sidecar_struct(clips: DataFrame) -> DataFrame:
    """One finished sidecar row per clip from flat facts.

    Reals keep six significant digits and become null when not finite; the gate value is null
    unless the clip was gated and the value is positive; empty device and note become null.
    """
    c = F.col
    empty_to_null = lambda name: F.nullif(c(name), F.lit(""))
    gate_value = F.when(c("gated") & (c("gate_psnr") > 0), R.six_digits("gate_psnr"))
    return clips.select(
        "clip_key",
        "tool_version",
        "sdk_version",
        c("input").alias("source"),
        "sha256",
        "width",
        "height",
        c("frames_done").alias("frame_count"),
        c("frame_count").alias("clip_frame_count"),
        F.concat_ws("/", "fps_num", "fps_den").alias("fps"),
        F.struct("channels", "sample_rate", "bits").alias("audio"),
        F.lit(COLOR_SPACE).alias("color_space"),
        F.lit(MATRIX).alias("matrix"),
        R.lens_text("lens").alias("lens_correction"),
        F.when(c("gpu_used"), "gpu").otherwise("cpu").alias("decode_path"),
        empty_to_null("gpu_device").alias("gpu_device"),
        gate_value.alias("gate_psnr_db"),
        empty_to_null("note").alias("decode_note"),
        F.struct(
            R.six_digits("kelvin").alias("kelvin"),
            R.six_digits("tint").alias("tint"),
            "iso",
            R.six_digits("exposure").alias("exposure"),
        ).alias("applied"),
        F.struct(
            F.lit(CODEC).alias("codec"),
            "crf",
            "preset",
            R.auto_keyint("fps_num", "fps_den", "keyint").alias("keyint"),
            F.greatest(c("min_keyint"), F.lit(1)).alias("min_keyint"),
            F.when(c("pools") > 0, c("pools")).otherwise(DEFAULT_POOLS).alias("pools"),
        ).alias("encode"),
        "success",
        "meta",
    )


def sidecar_json(clips: DataFrame) -> DataFrame:
    """``clip_key, text`` with nulls written out."""
    rows = sidecar_struct(clips)
    fields = [name for name in rows.columns if name != "clip_key"]
    return rows.select(
        "clip_key", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text")
    )


def write_sidecars(clips: DataFrame) -> None:
    """Write each clip's sidecar next to its output, whole or not at all."""
    write_files(
        sidecar_json(clips).select(
            F.concat("clip_key", F.lit(".sidecar.json")).alias("path"),
            F.col("text").alias("content"),
        )
    )


def write_files(files: DataFrame) -> None:
    """Write ``path, content`` rows as one file each, in place of what is there.

    A small table comes in few partitions however many files its rows make, so rows are dealt by their paths.
    """
    spark = files.sparkSession
    spark.dataSource.register(WholeFiles)
    rows = files.select("path", F.col("content").cast("binary"))
    rows.repartition(reading_tasks(spark), "path").write.format("wholefiles").mode(
        "append"
    ).save()


class WholeFiles(DataSource):
    """Sink that turns each row into a file, for folders that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "wholefiles"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return WholeFilesWriter()


@dataclass
class FilesWritten(WriterCommitMessage):
    count: int


class WholeFilesWriter(DataSourceWriter):
    """A file is seen whole or not at all: renamed into place, or closed by an object store."""

    def write(self, iterator):
        count, staged = 0, []
        try:
            for row in iterator:
                system, path = resolve(row.path)
                if isinstance(system, fs.LocalFileSystem):
                    staged.append((self._stage(path, row.content), path))
                    if len(staged) >= STAGED:
                        self._publish(staged)
                else:
                    with system.open_output_stream(path) as out:
                        out.write(row.content)
                count += 1
            self._publish(staged)
        finally:
            for (handle, _), _ in staged:
                os.close(handle)
        return FilesWritten(count)

    @staticmethod
    def _stage(path: str, content: bytes) -> tuple[int, str]:
        name = f"{path}.tmp-{uuid.uuid4().hex}"
        kind = os.O_CREAT | os.O_EXCL | os.O_WRONLY
        try:
            handle = os.open(name, kind, 0o666)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(name), exist_ok=True)
            handle = os.open(name, kind, 0o666)
        with open(handle, "wb", closefd=False) as out:
            out.write(content)
        return handle, name

    @staticmethod
    def _publish(staged: list[tuple[tuple[int, str], str]]) -> None:
        """Files that are staged get their names once all of them are on disk."""
        ready = staged[:]
        staged.clear()
        settle([handle for (handle, _), _ in ready])
        for (_, name), path in ready:
            os.replace(name, path)


def read_quality_logs(spark: SparkSession, path: str) -> DataFrame:
    """Quality log lines with their file and the values found; lines without values are left out."""
    lines = spark.read.text(path).select(_plain_path().alias("path"), F.col("value").alias("line"))
    return parse_quality_log(lines).filter("psnr_avg is not null or ssim is not null")


def failure_report(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """One text block per failed item: when, which, the command, and its last lines of output.

    ``runs`` has ``clip_key, status, ended, command``; ``lines`` has ``clip_key,
    output_line_no, output_line``. Only the last five lines of an item are ever brought together.
    """
    last = tail_n(lines, ["clip_key"], ["output_line_no", "output_line"], FAILURE_TAIL)
    listed = last.groupBy("clip_key").agg(
        F.array_sort(F.collect_list(F.struct("output_line_no", "output_line"))).alias("tail")
    )
    text = F.array_join(
        F.transform("tail", lambda t: F.concat(F.lit("    "), t["output_line"])), "\n"
    )
    head = F.concat(
        F.date_format("ended", "yyyy-MM-dd HH:mm:ss"), F.lit(" [failed] file: "), F.col("clip_key")
    )
    return (
        runs.filter("status = 'fail'")
        .join(listed, "clip_key", "left")
        .select(
            "clip_key",
            F.concat_ws(
                "\n", head, F.concat(F.lit("  command: "), F.col("command")), F.lit("  output:"), text
            ).alias("text"),
        )
    )


def write_failures(runs: DataFrame, lines: DataFrame, path: str) -> None:
    failure_report(runs, lines).select(F.concat("text", F.lit("\n")).alias("value")).write.mode(
        "append"
    ).text(path)
