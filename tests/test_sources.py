import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from clipledger.functions.arrow import framing_fault
from clipledger.operators import frames as V
from clipledger.operators import timeline as T
from clipledger.sources import archive as A
from clipledger.sources import documents as D
from clipledger.sources import rawframes, samplelog
from tests.data import by_clip, frame_of, random_archive
from tests.test_rules import planes_of

COLUMNS = ["seq", "is_video", "size", "pts", "dts", "is_key", "frame_no"]


def log_bytes(rows):
    out = struct.pack("<II", 0x4E524153, 2)
    for r in rows:
        out += struct.pack("<B4q", r["is_video"] | r["is_key"] << 1, r["size"], r["pts"], r["dts"], r["frame_no"])
    return out


@pytest.fixture
def logs(spark, tmp_path):
    samplelog.register(spark)
    archive = random_archive(5, clips=8)
    for clip, rows in archive.items():
        (tmp_path / f"{clip}.samples").write_bytes(log_bytes(rows))
    return archive, tmp_path


def expected(archive):
    return {c: sorted(tuple(r[k] for k in COLUMNS) for r in rows) for c, rows in archive.items() if rows}


def test_log_scan(spark, logs, monkeypatch):
    archive, folder = logs
    (folder / "torn.samples").write_bytes(log_bytes(archive["c0"][:2])[:-5])
    (folder / "head.samples").write_bytes(log_bytes([]))
    (folder / "note.txt").write_text("not a log")
    scan = spark.read.format("samplelog").option("clipId", "name")
    got = by_clip(scan.load(str(folder)), *COLUMNS)
    want = {**expected(archive), "torn": expected({"t": archive["c0"][:1]})["t"]}
    assert got == want
    one = by_clip(scan.load(f"{folder}/c[01].samples"), *COLUMNS)
    assert set(one) == {"c0", "c1"}
    paths = spark.read.format("samplelog").load(str(folder)).select("clip_id").distinct()
    assert f"{folder}/c0" in {r.clip_id for r in paths.collect()}


def test_no_logs_are_no_rows(spark, tmp_path):
    samplelog.register(spark)
    assert spark.read.format("samplelog").load(str(tmp_path)).count() == 0


def test_split_ranges():
    whole = [samplelog.LogRange("a", 0, 25), samplelog.LogRange("b", 0, 0), samplelog.LogRange("c", 0, 3)]
    splits = samplelog.split_ranges(whole, 10)
    seen = [(r.path, r.start, r.count) for s in splits for r in s.ranges]
    assert seen[:3] == [("a", 0, 10), ("a", 10, 10), ("a", 20, 5)]
    assert sum(c for _, _, c in seen) == 28 and ("b", 0, 0) in seen
    assert all(sum(r.count for r in s.ranges) <= 10 for s in splits)


@pytest.mark.parametrize("head", [b"", b"\0" * 8, struct.pack("<II", 0x4E524153, 1)])
def test_other_formats_are_rejected(spark, tmp_path, head):
    samplelog.register(spark)
    (tmp_path / "x.samples").write_bytes(head + b"\0" * 33)
    with pytest.raises(Exception, match="not a sample log"):
        spark.read.format("samplelog").load(str(tmp_path)).count()


def test_log_sink(spark, logs, tmp_path_factory):
    archive, folder = logs
    out = tmp_path_factory.mktemp("sink")
    df = frame_of(spark, archive).repartition(5, "size")
    ranged = tmp_path_factory.mktemp("ranged")
    samplelog.write_logs(df, str(ranged))
    df.write.format("samplelog").mode("append").save(str(out))
    for clip, rows in archive.items():
        assert (ranged / f"{clip}.samples").read_bytes() == log_bytes(rows)
        assert (out / f"{clip}.samples").read_bytes() == log_bytes(rows)
    assert not [n for n in os.listdir(out) if n.startswith("_")]
    with pytest.raises(Exception, match="FileExists"):
        df.write.format("samplelog").mode("append").save(str(out))
    gap = df.filter("seq <> 0")
    with pytest.raises(Exception, match="not numbered"):
        gap.write.format("samplelog").mode("overwrite").save(str(out))
    assert (out / "c0.samples").read_bytes() == log_bytes(archive["c0"])
    odd = spark.createDataFrame([("/a/b c.mov", 0, True, 1, 2, 3, True, 4)], df.schema)
    odd.write.format("samplelog").mode("overwrite").save(str(out))
    back = spark.read.format("samplelog").option("clipId", "name").load(str(out))
    assert back.filter("clip_id = '/a/b c.mov'").count() == 1


def test_log_sink_numbering_and_overwrite(spark, tmp_path):
    schema = "clip_id string, seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, is_key boolean, frame_no bigint"
    rows = lambda clip, seqs: spark.createDataFrame(
        [(clip, s, True, 1, 2, 3, True, 4) for s in seqs], schema
    )
    # The last set has the count and the sums of powers of 0..11.
    for seqs in ([0, 0, 2], [0, 2], [1, 2], [1, 2, 9, 10, 1, 2, 3, 5, 6, 8, 9, 10]):
        with pytest.raises(Exception, match="not numbered"):
            samplelog.write_logs(rows("bad", seqs), str(tmp_path / "out"), "overwrite")
    samplelog.write_logs(rows("old", range(70_000)), str(tmp_path / "out"), "overwrite")
    samplelog.write_logs(rows("new", range(5)), str(tmp_path / "out"), "overwrite")
    assert os.listdir(tmp_path / "out") == ["new.samples"]


def test_paths_keep_their_store(monkeypatch, tmp_path):
    from pyarrow import fs

    from clipledger.sources import files

    (tmp_path / "bucket" / "dir").mkdir(parents=True)
    (tmp_path / "bucket" / "dir" / "a b.samples").write_bytes(b"abc")
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())

    class Stores:
        @staticmethod
        def from_uri(path):
            return store, path.split("://")[1]

    monkeypatch.setattr(files.fs, "FileSystem", Stores)
    for asked in ("s3a://bucket/dir", "s3a://bucket/dir/*.samples", "s3a://bucket/dir/a b.samples"):
        ((path, size),) = files.list_files(asked.replace("s3a", "s3"), ".samples")
        assert (path, size) == ("s3://bucket/dir/a b.samples", 3)
        with files.open_file(path) as handle:
            assert handle.read() == b"abc"


def test_encoded_paths(spark, tmp_path):
    from clipledger.sources import documents

    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "c+d %41#é.mov.ckpt").write_text('{"version": 1}')
    (row,) = documents.read_checkpoints(spark, str(tmp_path)).select("clip_key").collect()
    assert row.clip_key == str(folder / "c+d %41#é.mov")


def box(kind, body, size=None, wide=None):
    n = len(body) + 8 if size is None else size
    if wide is not None:
        return struct.pack(">I4sQ", 1, kind, wide) + body
    return struct.pack(">I4s", n, kind) + body


def units(*parts):
    return b"".join(struct.pack(">I", len(p)) + p for p in parts)


def test_box_index_and_payload(spark, tmp_path):
    ftyp = box(b"ftyp", b"12345678")
    packets = [units(b"abcd", b"ef"), b"\x01\x02\x03", units(b"zz"), struct.pack(">I", 99) + b"broken", units(b"never there")]
    data = b"".join(packets[:4])
    made = {
        "done": ftyp + box(b"mdat", data) + box(b"moov", b"x" * 40),
        "open": ftyp + box(b"mdat", data, size=0),
        "wide": ftyp + box(b"wide", b"") + box(b"mdat", data, wide=len(data) + 16) + box(b"moov", b""),
        "over": ftyp + box(b"mdat", data, size=9999),
        "none": ftyp + box(b"free", b"q"),
        "short": b"abc",
    }
    for name, raw in made.items():
        (tmp_path / f"{name}.h265.mov.part").write_bytes(raw)
    found = A.scan_artifacts(spark, str(tmp_path))
    assert {r.kind for r in found.collect()} == {"part"}
    rows = {os.path.basename(r.path).split(".")[0]: r for r in A.box_index(found).collect()}
    assert (rows["done"].data_start, rows["done"].data_bound) == (24, 24 + len(data))
    assert (rows["open"].data_start, rows["open"].data_bound) == (24, len(made["open"]))
    assert (rows["wide"].data_start, rows["wide"].data_bound) == (40, 40 + len(data))
    assert rows["over"].data_bound == len(made["over"])
    assert (rows["none"].data_start, rows["none"].data_bound) == (None, len(made["none"]))
    assert (rows["short"].data_start, rows["short"].data_bound) == (None, 3)
    assert [b.type for b in rows["wide"].boxes] == ["ftyp", "wide", "mdat"]

    log = {
        name: [
            dict(clip_id=name, seq=i, is_video=i != 1, size=len(p), pts=i, dts=i, is_key=False, frame_no=i)
            for i, p in enumerate(packets)
        ]
        for name in made
    }
    files = found.withColumn("clip_id", F.regexp_extract("path", r"([^/.]*)\.h265", 1))
    ranges = A.attach_payload(frame_of(spark, log), A.box_index(found), files)
    for row in ranges.collect():
        raw = made[row.clip_id][row.offset : row.offset + row.size]
        assert raw == packets[row.seq]
    # The trailing box of the finished file must not let the last, unwritten packet in.
    assert {r.clip_id: r["count"] for r in ranges.groupBy("clip_id").count().collect()} == {n: 4 for n in ("done", "open", "wide", "over")}
    faults = A.audit_framing(ranges).collect()
    assert {(r.clip_id, r.frame_no) for r in faults} == {(n, 3) for n in ("done", "open", "wide", "over")}


def test_framing():
    assert framing_fault(units(b"abc", b"d")) is None
    assert framing_fault(b"short") is None
    assert "empty unit" in framing_fault(units(b"abcd", b""))
    assert "over the end" in framing_fault(struct.pack(">I", 9) + b"12345")
    assert "left over" in framing_fault(units(b"abcd") + b"xy")


def test_content_hash_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.NEV").write_bytes(b"abc" * 1000)
    df = spark.createDataFrame([(str(tmp_path / "a.NEV"),), (str(tmp_path / "gone.NEV"),)], "path string")
    got = {os.path.basename(r.path): r.sha256 for r in A.content_hash(df).collect()}
    assert got == {"a.NEV": hashlib.sha256(b"abc" * 1000).hexdigest(), "gone.NEV": ""}


def test_checkpoint_files(spark, tmp_path):
    good = {"version": 1, "toolVersion": "2", "input": 'a"b\\c', "sourceSha256": "", "settingsHash": "s", "videoFrames": 5, "audioEndSample": 6, "totalFrames": 7}
    (tmp_path / "ok.h265.mov.ckpt").write_text(json.dumps(good))
    (tmp_path / "anon.h265.mov.ckpt").write_text(json.dumps({k: v for k, v in good.items() if k != "input"}))
    for missing in ("version", "totalFrames", "sourceSha256"):
        (tmp_path / f"{missing}.h265.mov.ckpt").write_text(json.dumps({k: v for k, v in good.items() if k != missing}))
    (tmp_path / "torn.h265.mov.ckpt").write_text(json.dumps(good)[:30])
    rows = {os.path.basename(r.clip_key).split(".")[0]: r for r in D.read_checkpoints(spark, str(tmp_path)).collect()}
    assert {k for k, r in rows.items() if r.is_valid} == {"ok", "anon"}
    assert rows["ok"].input == 'a"b\\c' and rows["ok"].videoFrames == 5
    assert rows["ok"].clip_key == f"{tmp_path}/ok.h265.mov"


def test_checkpoint_table_keeps_whole_versions(spark, tmp_path):
    path = str(tmp_path / "ck")
    schema = "clip_key string, version int, toolVersion string, input string, sourceSha256 string, settingsHash string, videoFrames bigint, audioEndSample bigint, totalFrames bigint, taken int"
    row = lambda key, frames, taken: (key, 1, "2", 'q"', None, "s", frames, 0, 9, taken)
    assert D.write_checkpoints(spark.createDataFrame([row("a", 1, 1), row("a", 5, 2), row("b", 2, 1)], schema), path, "taken") == 0
    assert D.write_checkpoints(spark.createDataFrame([row("a", 9, 3)], schema), path, "taken") == 1
    os.makedirs(f"{path}/version=7")
    read = lambda: sorted((r.clip_key, r.videoFrames, r.sourceSha256, r.input, r.is_valid) for r in D.read_checkpoint_table(spark, path).collect())
    assert read() == [("a", 9, "", 'q"', True), ("b", 2, "", 'q"', True)]
    # The same batch once more gives the same table; the unfinished one is never seen.
    D.checkpoint_sink(path, "taken")(spark.createDataFrame([row("a", 9, 3)], schema), 1)
    assert read() == [("a", 9, "", 'q"', True), ("b", 2, "", 'q"', True)]
    # A new query counts its batches from 0 again: its snapshots are seen, old versions go.
    D.checkpoint_sink(path, "taken", 2)(spark.createDataFrame([row("b", 8, 4)], schema), 0)
    assert read() == [("a", 9, "", 'q"', True), ("b", 8, "", 'q"', True)]
    assert D.checkpoint_versions(path) == [2, 3]
    with pytest.raises(FileNotFoundError):
        D.read_checkpoint_table(spark, str(tmp_path / "nothing"))


def test_sidecar_text(spark, tmp_path):
    facts = dict(
        clip_key=f"{tmp_path}/a.h265.mov", tool_version="1", sdk_version="9", input='/x/"q"\n\t\\.NEV', sha256="ab",
        width=640, height=360, frames_done=119, frame_count=120, fps_num=60000, fps_den=1001, channels=2,
        sample_rate=48000, bits=24, lens=1, gpu_used=True, gpu_device="", gated=True, gate_psnr=61.23456789,
        note="", kelvin=5600.0, tint=float("nan"), iso=800, exposure=float("inf"), crf=14, preset="slow",
        keyint=0, min_keyint=1, pools=0, success=True,
    )
    df = spark.createDataFrame([tuple(facts.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string'}"
        for k, v in facts.items()
    )).withColumn("meta", F.array(F.array(F.lit("lens"), F.lit('5"0'))))
    D.write_sidecars(df)
    text = (tmp_path / "a.h265.mov.sidecar.json").read_text()
    doc = json.loads(text)
    assert doc["source"] == facts["input"] and doc["fps"] == "60000/1001"
    assert doc["gate_psnr_db"] == 61.2346 and doc["gpu_device"] is None and doc["decode_note"] is None
    assert doc["applied"] == {"kelvin": 5600, "tint": None, "iso": 800, "exposure": None}
    assert doc["encode"] == {"codec": "hevc main10", "crf": 14, "preset": "slow", "keyint": 120, "min_keyint": 1, "pools": 8}
    assert doc["meta"] == [["lens", '5"0']] and doc["decode_path"] == "gpu" and doc["frame_count"] == 119
    back = D.read_sidecars(spark, str(tmp_path)).first()
    assert back.clip_key == facts["clip_key"] and back.meta == [["lens", '5"0']]
    plain = D.read_sidecar_files(spark, str(tmp_path)).first()
    assert (plain.path, plain.text) == (facts["clip_key"], text)
    ungated = D.sidecar_json(df.withColumn("gated", F.lit(False))).first().text
    assert json.loads(ungated)["gate_psnr_db"] is None


def test_failures(spark, tmp_path):
    runs = spark.createDataFrame(
        [("a.NEV", "fail", "run a"), ("b.NEV", "ok", "run b"), ("c.NEV", "fail", "run c")], "clip_key string, status string, command string"
    ).withColumn("ended", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    lines = spark.createDataFrame([("a.NEV", i, f"line {i}") for i in range(12)], "clip_key string, output_line_no bigint, output_line string")
    got = {r.clip_key: r.text.split("\n") for r in D.failure_report(runs, lines).collect()}
    assert got["a.NEV"] == ["2024-01-02 03:04:05 [failed] file: a.NEV", "  command: run a", "  output:"] + [f"    line {i}" for i in range(7, 12)]
    assert got["c.NEV"][-1] == "  output:" and set(got) == {"a.NEV", "c.NEV"}
    D.write_failures(runs, lines, str(tmp_path / "log"))
    D.write_failures(runs, lines, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).filter("value like '%[failed]%'").count() == 4


def test_raw_frames(spark, tmp_path):
    rawframes.register(spark)
    w, h = 16, 9
    for name, shift in (("a", 0), ("b", 1)):
        (tmp_path / f"{name}.rgb").write_bytes(b"".join(planes_of(n + shift)[0] for n in range(7)) + b"torn")
    scan = lambda: spark.read.format("rawframes").options(width=w, height=h, suffix=".rgb")
    rows = scan().load(str(tmp_path)).collect()
    assert len(rows) == 14 and all(bytes(r.planes) == planes_of(r.frame_no + r.clip_id.endswith("b.rgb"))[0] for r in rows)
    some = scan().option("minFrame", 2).option("maxFrame", 4).load(str(tmp_path))
    assert sorted(r.frame_no for r in some.collect()) == [2, 2, 3, 3]
    for rule, want in (("frame_no >= 2 and frame_no < 4", [2, 2, 3, 3]), ("frame_no = 1", [1, 1]), ("2 < frame_no and frame_no <= 3", [3, 3])):
        rows = scan().load(str(tmp_path)).filter(rule)
        assert sorted(r.frame_no for r in rows.collect()) == want
    reader = rawframes.RawFrameReader({"path": str(tmp_path), "width": str(w), "height": str(h), "suffix": ".rgb"})
    asked = [rawframes.GreaterThanOrEqual(("frame_no",), 2), rawframes.LessThan(("frame_no",), 3), rawframes.EqualTo(("clip_id",), "a")]
    assert list(reader.pushFilters(asked)) == asked[2:] and (reader.low, reader.high) == (2, 3)
    assert rawframes.frame_bytes(3, 5, "yuv420p10") == (15 + 2 * 2 * 3) * 2
    with pytest.raises(ValueError):
        rawframes.frame_bytes(3, 5, "rgb8")
    pairs = spark.createDataFrame([("c", str(tmp_path / "a.rgb"), str(tmp_path / "b.rgb"), 8)], "clip_id string, path_a string, path_b string, frame_count bigint")
    by_file = {r.frame_no: r.psnr for r in V.compare_files(pairs, w, h, split_bytes=4 * w * h * 6).collect()}
    both = scan().load(str(tmp_path)).withColumn("run", F.regexp_extract("clip_id", r"(.)\.rgb", 1)).withColumn("clip_id", F.lit("c"))
    by_join = {r.frame_no: r.psnr for r in V.compare_runs(both.filter("run = 'a'"), both.filter("run = 'b'")).collect()}
    assert by_file.pop(7) is None
    assert by_file == by_join and len(by_join) == 7


def test_split_frames():
    splits = rawframes.split_frames([("a", 0, 7), ("b", 0, 1), ("c", 3, 3), ("d", 0, 2)], 4)
    assert [s.ranges for s in splits] == [[("a", 0, 4)], [("a", 4, 3), ("b", 0, 1)], [("d", 0, 2)]]


def test_torn_tail_resumes(spark, logs):
    """A log that is ahead of its data only counts what the data holds."""
    archive, folder = logs
    df = spark.read.format("samplelog").option("clipId", "name").load(str(folder))
    bounds = spark.createDataFrame([(c, 0, 50) for c in archive], "clip_id string, data_start bigint, data_bound bigint")
    cut = T.complete_prefix(df, bounds)
    assert all(r.offset + r.size <= 50 for r in cut.collect())
