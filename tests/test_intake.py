"""Listing by tasks, bounded intake of growing logs, and logs as parts with a manifest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from clipledger.operators import timeline as T
from clipledger.sources import files, intake, listing, logparts, rawframes, samplelog
from clipledger.streaming import keyed as K
from tests.data import by_clip, frame_of, random_archive
from tests.test_sources import COLUMNS, expected, log_bytes


def tree(root):
    for name in ("a.samples", "b.txt", "x/c.samples", "x/y/d.samples", "x/y z%/é#.samples", "w/e.samples"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "empty").mkdir()


def test_list_tree_equals_a_driver_listing(spark, tmp_path):
    tree(tmp_path)
    listed = lambda p, s="": sorted(map(tuple, listing.list_tree(spark, p, s).collect()))
    for asked, suffix in (
        (str(tmp_path), ""), (str(tmp_path), ".samples"), (f"{tmp_path}/x/", ".samples"), (f"file:{tmp_path}/x", ""),
        (f"{tmp_path}/a.samples", ""), (f"{tmp_path}/x/*/*.samples", ""), (f"{tmp_path}/[aw]*", ""), (f"{tmp_path}/empty", ""),
    ):
        assert listed(asked, suffix) == files.list_files(asked, suffix), asked
    with pytest.raises(FileNotFoundError):
        listing.list_tree(spark, f"{tmp_path}/none")


def test_scan_logs_equals_the_source(spark, tmp_path, monkeypatch):
    samplelog.register(spark)
    archive = random_archive(5, clips=8)
    (tmp_path / "sub").mkdir()
    for i, (clip, rows) in enumerate(archive.items()):
        (tmp_path / ("sub" if i % 2 else ".") / f"{clip}.samples").write_bytes(log_bytes(rows))
    (tmp_path / "torn.samples").write_bytes(log_bytes(archive["c0"][:2])[:-5])
    (tmp_path / "head.samples").write_bytes(log_bytes([]))
    monkeypatch.setattr(intake, "RANGE_RECORDS", 7)
    want = {**expected(archive), "torn": expected({"t": archive["c0"][:1]})["t"]}
    assert by_clip(intake.scan_logs(spark, str(tmp_path), by_name=True), *COLUMNS) == want
    by_path = spark.read.format("samplelog").load(str(tmp_path))
    assert sorted(map(tuple, intake.scan_logs(spark, str(tmp_path)).collect())) == sorted(map(tuple, by_path.collect()))
    (tmp_path / "bad.samples").write_bytes(b"\0" * 8)
    with pytest.raises(Exception, match="not a sample log"):
        intake.scan_logs(spark, str(tmp_path)).count()


def test_scan_frames_equals_the_source(spark, tmp_path):
    rawframes.register(spark)
    for name, frames in (("a.rgb", 5), ("b.rgb", 0), ("c.rgb", 2)):
        (tmp_path / name).write_bytes(os.urandom(24 * frames + 3))
    source = spark.read.format("rawframes").option("width", 2).option("height", 2).load(str(tmp_path))
    rows = lambda df: sorted((r.clip_id, r.frame_no, r.width, r.height, bytes(r.planes)) for r in df.collect())
    assert rows(rawframes.scan_frames(spark, str(tmp_path), 2, 2)) == rows(source)
    cut = rawframes.scan_frames(spark, str(tmp_path), 2, 2, frames=(1, 3))
    assert rows(cut) == rows(source.filter("frame_no >= 1 and frame_no < 3"))


def grow(folder, archive, share):
    for clip, log in archive.items():
        raw = log_bytes(log)
        (folder / f"{clip}.samples").write_bytes(raw if share == 1 else raw[: 8 + int((len(raw) - 8) * share)])


def test_intake_takes_each_record_once_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "SUM_EVERY", 3)
    logs = tmp_path / "logs"
    logs.mkdir()
    archive = random_archive(82, clips=5, longest=40)
    total = sum(map(len, archive.values()))
    grower = intake.LogIntake(spark, str(logs), str(tmp_path / "in"), max_records=25, by_name=True)
    assert grower.plan() == 0
    sizes = []

    def count(batch, number):
        rows = batch.select("clip_id", "seq").collect()
        sizes.append(len(rows))
        seen.extend(map(tuple, rows))

    seen = []
    for share in (0.3, 0.3, 0.7, 1):
        grow(logs, archive, share)
        made = grower.plan()
        assert (made == 0) == (share == 0.3 and bool(sizes))
        query = grower.stream().writeStream.foreachBatch(count).option("checkpointLocation", str(tmp_path / "go")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(sizes) <= 25 and len(sizes) >= total // 25
    assert sorted(seen) == sorted((c, p) for c, log in archive.items() for p in range(len(log)))
    # Records of a log come in order: the stream of complete packets takes them.
    sized = {c: [{**p, "size": abs(p["size"])} for p in log] for c, log in archive.items()}
    grow(logs, sized, 1)
    again = intake.LogIntake(spark, str(logs), str(tmp_path / "second"), max_records=60, by_name=True)
    again.plan()
    bounds = spark.createDataFrame([(c, 0, sum(p["size"] for p in log) // 2) for c, log in sized.items()], "clip_id string, data_start bigint, data_bound bigint")
    got = K.keyed_resume(spark, bounds).drain(again.stream(2))
    assert by_clip(got, "seq", "offset") == by_clip(T.complete_prefix(frame_of(spark, sized), bounds), "seq", "offset")


def test_offset_stays_small(spark, tmp_path):
    logs = tmp_path / "logs"
    for i in range(100):
        (logs / str(i)).mkdir(parents=True)
    one = log_bytes([dict(is_video=True, is_key=False, size=1, pts=1, dts=1, frame_no=1)])
    for i in range(10_000):
        (logs / str(i % 100) / f"{i}.samples").write_bytes(one)
    grower = intake.LogIntake(spark, str(logs), str(tmp_path / "in"), max_records=6000)
    assert grower.plan() == 3
    query = (
        grower.stream().groupBy().count().writeStream.format("memory").queryName("counted").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "go")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("counted").first()[0] == 10_000
    offsets = [(tmp_path / "go" / "offsets" / n).read_text() for n in os.listdir(tmp_path / "go" / "offsets") if n.isdigit()]
    assert len(offsets) >= 2 and all(len(o.split("\n")[-1]) < 1000 for o in offsets)
    assert [p["sources"][0]["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [4501, 4501, 998]


# --- parts ----------------------------------------------------------------------------------------------


@pytest.fixture(params=["local", "store"])
def place(request, tmp_path, monkeypatch):
    """A local folder, and a store that is no local file system: it takes whole objects only."""
    if request.param == "local":
        return str(tmp_path / "out")
    base = str(tmp_path)

    def resolve(path):
        from pyarrow import fs

        if path.startswith("mem://"):
            return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), path[len("mem://") :]
        return fs.FileSystem.from_uri("/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path)

    monkeypatch.setattr(files, "resolve", resolve)
    return "mem://bucket/out"


def test_parts_round_trip(spark, place, monkeypatch):
    monkeypatch.setattr(logparts, "PART_RECORDS", 40)
    archive = random_archive(6, clips=9)
    df = frame_of(spark, archive).repartition(5, "size")
    assert logparts.read_log_parts(spark, place).count() == 0
    logparts.write_log_parts(df, place)
    assert by_clip(logparts.read_log_parts(spark, place), *COLUMNS) == expected(archive)
    with pytest.raises(FileExistsError):
        logparts.write_log_parts(df.filter("clip_id = 'c3'"), place)
    with pytest.raises(ValueError, match="not numbered"):
        logparts.write_log_parts(df.filter("seq <> 0"), place, "overwrite")
    odd = spark.createDataFrame([("/a/b c%.mov", 0, True, 1, 2, 3, True, 4)], df.schema)
    logparts.write_log_parts(odd, place)
    both = by_clip(logparts.read_log_parts(spark, place), *COLUMNS)
    assert both == {**expected(archive), "/a/b c%.mov": [(0, True, 1, 2, 3, True, 4)]}
    joined = {r.path.rsplit("/", 1)[1]: r for r in logparts.join_logs(spark, place, f"{place}-joined").collect()}
    with files.open_file(joined["c2.samples"].path) as handle:
        assert handle.read() == log_bytes(archive["c2"])
    assert joined["c2.samples"].records == len(archive["c2"])
    logparts.write_log_parts(odd, place, "overwrite")
    assert logparts.read_log_parts(spark, place).count() == 1


@pytest.mark.parametrize("seqs", [[0, 0, 2], [0, 2], [1, 2], [0, 1, 1, 2], [0, 1, 1]])
def test_parts_are_numbered(spark, tmp_path, seqs):
    schema = "clip_id string, seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, is_key boolean, frame_no bigint"
    rows = spark.createDataFrame([("bad", s, True, 1, 2, 3, True, 4) for s in seqs], schema)
    with pytest.raises(ValueError, match="not numbered"):
        logparts.write_log_parts(rows, str(tmp_path / "out"))
    assert logparts.read_log_parts(spark, str(tmp_path / "out")).count() == 0


def test_what_is_not_committed_is_not_seen(spark, tmp_path):
    """Parts and manifests of a write that broke off stay unread."""
    archive = random_archive(7, clips=3)
    place = str(tmp_path / "out")
    logparts.write_log_parts(frame_of(spark, archive), place)
    current = json.loads((tmp_path / "out" / logparts.CURRENT).read_text())
    logparts.write_log_parts(frame_of(spark, {"more": [{**r, "clip_id": "more"} for r in archive["c0"]]}), place)
    (tmp_path / "out" / logparts.CURRENT).write_text(json.dumps(current))
    assert by_clip(logparts.read_log_parts(spark, place), *COLUMNS) == expected(archive)
    assert logparts.manifest(spark, place).agg(F.sum("records")).first()[0] == sum(map(len, archive.values()))


# --- checkpoints by bucket ---------------------------------------------------------------------------------

CKPT = "clip_key string, version int, toolVersion string, input string, sourceSha256 string, settingsHash string, videoFrames bigint, audioEndSample bigint, totalFrames bigint, taken int"


def test_checkpoint_buckets(spark, tmp_path):
    from clipledger.sources import documents as D

    path = str(tmp_path / "ck")
    row = lambda key, frames, taken: (key, 1, "2", 'q"', None, "s", frames, 0, 9, taken)
    rows = lambda *r: spark.createDataFrame(list(r), CKPT)
    read = lambda: sorted((r.clip_key, r.videoFrames) for r in D.read_checkpoint_buckets(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        read()
    many = {f"clip {i}": i for i in range(300)}
    assert D.write_checkpoint_buckets(rows(*(row(k, n, 1) for k, n in many.items()), row("clip 5", 77, 2)), path, "taken", buckets=8) == 0
    many["clip 5"] = 77
    assert read() == sorted(many.items())
    size = lambda f: sum(p.stat().st_size for p in (tmp_path / "ck" / "data").glob(f"{f}-*/bucket=*/*.parquet"))
    # One clip changes: one bucket is written.
    assert D.write_checkpoint_buckets(rows(row("clip 9", 1000, 3)), path, "taken", buckets=8) == 1
    many["clip 9"] = 1000
    assert read() == sorted(many.items()) and size(1) < size(0) / 4
    # The same version once more gives the same table, an empty batch changes nothing.
    D.write_checkpoint_buckets(rows(row("clip 9", 1000, 3)), path, "taken", version=1, buckets=8)
    D.checkpoint_bucket_sink(path, "taken")(rows(), 0)
    assert read() == sorted(many.items())
    for k in range(3):
        D.write_checkpoint_buckets(rows(row("new", k, k)), path, "taken", buckets=8)
    D.drop_bucket_versions(path, 2)
    many["new"] = 2
    assert read() == sorted(many.items())
    assert sorted(os.listdir(tmp_path / "ck" / "versions")) == ["4.json", "5.json"]
