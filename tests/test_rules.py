import hashlib
import json
import math

from pyspark.sql import functions as F

from clipledger.functions import rules as R
from clipledger.operators import artifacts as P
from clipledger.operators import frames as V
from clipledger.operators import quality as Q
from clipledger.operators import settings as S
from clipledger.operators import verify as C


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {schema}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_names(spark):
    paths = ["a.NEV", "/x.y/a", "/x.y/a.b.nev", "a", ".nev", "/d/.h"]
    assert values(spark, paths, "string", R.default_output("x")) == [
        "a.h265.mov", "/x.y/a.h265.mov", "/x.y/a.b.h265.mov", "a.h265.mov", ".h265.mov", "/d/.h265.mov",
    ]


def test_kinds(spark):
    paths = ["a.h265.mov", "a.h265.mov.part", "a.h265.mov.part.old", "a.h265.mov.samples",
             "a.h265.mov.ckpt", "a.h265.mov.sidecar.json", "a.NEV", "b.nev", "c.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = {r.path: (r.kind, r.clip_key) for r in P.classify(df).collect()}
    kinds = ["output", "part", "part_old", "samples", "ckpt", "sidecar", "source", "source", None]
    assert [rows[p][0] for p in paths] == kinds
    assert {rows[p][1] for p in paths[:7]} == {"a.h265.mov"}
    assert rows["b.nev"][1] == "b.h265.mov"


def test_durations(spark):
    secs = [-5.0, 0.0, 0.49, 0.5, 59.5, 60.0, 3599.4, 3599.5, 36000.0, 400000.0]
    assert values(spark, secs, "double", R.fmt_duration("x")) == [
        "00:00", "00:00", "00:00", "00:01", "01:00", "01:00", "59:59", "1:00:00", "10:00:00", "111:06:40",
    ]


def test_rates(spark):
    texts = ["60000/1001", "24/1", "25", "0/1", "24/0", "x/1", "1/1000", None]
    assert values(spark, texts, "string", R.segment_frames("x"))[:7] == [599, 600, 600, 600, 600, 600, 1]
    pair = R.parse_rational("x")
    assert values(spark, texts, "string", F.struct(pair.num, pair.den)) == [
        (60000, 1001), (24, 1), (None, None), (0, 1), (24, 0), (None, None), (1, 1000), (None, None),
    ]


def test_packet_duration(spark):
    df = spark.createDataFrame(
        [(True, 9, 1001, 2), (False, 25, 1001, 2), (False, 25, 1001, 0)],
        "is_video boolean, size bigint, fps_den bigint, channels int",
    )
    ticks = R.packet_duration("is_video", "size", "fps_den", "channels")
    assert [r.t for r in df.select(ticks.alias("t")).collect()] == [1001, 4, 4800]


def test_keyint(spark):
    df = spark.createDataFrame(
        [(60000, 1001, 0), (24, 1, 0), (1, 10, 0), (24, 1, 33)], "n bigint, d bigint, k bigint"
    )
    assert [r.y for r in df.select(R.auto_keyint("n", "d", "k").alias("y")).collect()] == [120, 48, 1, 33]


def test_fingerprint_text(spark):
    df = spark.createDataFrame(
        [(0, 0, float("nan"), 0, float("nan"), 1, -1, 14, "slow", 0, 1, 1, 16, False, False, -1, 7, 3, 2)],
        "decode_mode int, kelvin int, tint float, iso bigint, exposure float, lens int, chroma_nr int, "
        "crf int, preset string, keyint int, min_keyint int, open_gop int, buffers int, "
        "faststart boolean, no_audio boolean, max_frames bigint, jobs int, pools int, cpu_workers int",
    )
    want = (
        "decode=0|kelvin=0|tint=nan|iso=0|exposure=nan|lens=1|chromaNr=-1|crf=14|preset=slow|keyint=0"
        "|minKeyint=1|openGop=1|buffers=16|faststart=0|noAudio=0|maxFrames=-1"
    )
    assert df.select(S.settings_text(df).alias("t")).first().t == want
    made = S.settings_hash(df).first().settings_hash
    assert made == hashlib.sha256(want.encode()).hexdigest()
    faster = df.withColumns({"jobs": F.lit(64), "pools": F.lit(9), "cpu_workers": F.lit(5)})
    assert S.settings_hash(faster).first().settings_hash == made
    other = df.withColumn("buffers", F.lit(8)).withColumn("tint", F.lit(0.1).cast("float"))
    assert "tint=0.100000|" in other.select(S.settings_text(other).alias("t")).first().t
    assert S.settings_hash(other).first().settings_hash != made


def test_violations(spark):
    df = spark.createDataFrame(
        [("ok", 5600, 0.5, 14, 120, 1, -1), ("bad", 100001, -101.0, 52, 5, 9, 0), ("nul", None, float("nan"), 0, 0, 50, 9)],
        "clip_id string, kelvin int, tint double, crf int, keyint int, min_keyint int, max_frames bigint",
    )
    got = sorted((r.clip_id, r.rule) for r in S.validate_settings(df).collect())
    assert got == [
        ("bad", "crf"), ("bad", "kelvin"), ("bad", "max_frames"), ("bad", "min_keyint above keyint"),
        ("bad", "tint"), ("nul", "tint"),
    ]


def test_progress_counts_frames_not_seconds(spark):
    df = spark.createDataFrame(
        [(50, 100, 60000, 1001, 5.0, 1000.0), (200, 100, 24, 1, 0.01, 1000.0), (0, 0, 0, 0, 1.0, 0.0)],
        "done bigint, total bigint, fps_num bigint, fps_den bigint, fps double, now_epoch double",
    )
    one, two, three = S.progress(df).collect()
    assert (one.fraction, one.work_left_s, one.eta_epoch) == (0.5, 10.0, 1010.0)
    assert one.bar == "#" * 10 + "-" * 10 and one.left_text == "00:10"
    assert (two.fraction, two.work_left_s, two.bar) == (1.0, 0.0, "#" * 20)
    assert (three.fraction, three.media_total_s) == (0.0, 0.0)


def test_fps_and_audio_rules(spark):
    df = spark.createDataFrame(
        [(60000, None, 24, 1), (None, None, 30000, 1001), (0, 0, 1, 1), (3000000, 1, 1, 1)],
        "record_num bigint, record_den bigint, container_num bigint, container_den bigint",
    )
    rows = [(r.fps_num, r.fps_den, r.fps_reject) for r in S.normalize_fps(df).collect()]
    assert rows == [(60000, 1, False), (30000, 1001, False), (1, 1, False), (3000000, 1, True)]
    df = spark.createDataFrame(
        [(2, 5, 48000, 24), (2, 5, 0, 24), (0, 5, 0, 16), (2, 5, 400000, 16), (1, 1, 384000, None)],
        "channels int, block_count bigint, sample_rate int, bits int",
    )
    rows = [(r.audio_present, r.sample_rate, r.audio_reject) for r in S.check_audio(df).collect()]
    assert rows == [(True, 48000, False), (True, 48000, False), (False, 0, False), (True, 48000, True), (True, 384000, True)]


def test_json_first_and_meta(spark):
    docs = [
        '{"a": {"hash": "deep"}, "sha256": "top"}',
        '{"src": {"sha_256": "in"}, "hash": "x"}',
        '{"sha256": null}',
        '{"crf": 14, "x": {"hash": 9}}',
        "{}",
    ]
    keys = ["sha256", "sha_256", "sha-256", "hash"]
    assert values(spark, docs, "string", R.json_first("x", keys)) == ["top", "in", None, "9", None]
    assert values(spark, docs, "string", R.json_has("x", "sha256")) == [True, False, True, False, False]
    nested = [r'{"n": {"hash": "/in/x \"y\".NEV"}}', r'{"note": "\"hash\": \"no\""}', '{"hash": false, "x": {"sha256": "s"}}']
    assert values(spark, nested, "string", R.json_first("x", ["hash", "sha256"])) == ['/in/x "y".NEV', None, "s"]
    assert values(spark, nested, "string", R.json_has("x", "sha256")) == [False, False, False]
    df = spark.createDataFrame([([["iso", "800"], ["iso", "100"], ["b", None]],)], "m array<array<string>>")
    row = df.select(R.meta_map("m").alias("m"), R.meta_value("m", "iso").alias("iso"), R.meta_value("m", "z").alias("z")).first()
    assert (row.m, row.iso, row.z) == ({"iso": "800", "b": None}, "800", None)


def test_repack_vectors(spark):
    words = bytes.fromhex("00800000 00008000 00000080 12345600 ffffff00 00000000".replace(" ", ""))
    # The vectors are words; in memory they are little-endian.
    raw = b"".join(words[i : i + 4] for i in range(0, 24, 4))
    df = spark.createDataFrame([("a", 0, bytearray(raw))], "clip_id string, block_idx bigint, payload binary")
    row = V.repack_blocks(df).first()
    want = b"".join(bytes([raw[i + 2], raw[i + 1], raw[i]]) for i in range(0, 24, 4))
    assert bytes(row.payload) == want and len(want) == 18
    assert row.block_hash == hashlib.sha256(want).hexdigest()


def test_sha_vectors(spark):
    texts = ["", "abc", "The quick brown fox jumps over the lazy dog",
             "abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq", None]
    got = values(spark, texts, "string", R.sha256_text("x"))
    assert got[0][:8] == "e3b0c442" and got[1][:8] == "ba7816bf" and got[2][:8] == "d7a8fbb3"
    assert got[3][:8] == "248d6a61" and got[4] == ""


def planes_of(n, w=16, h=9):
    """Pixels of the synthetic clip: three planes of 16-bit values."""
    size = w * h
    values = [
        (a * i + b * n) & 0x3FFF for a, b in ((7, 13), (5, 17), (3, 19)) for i in range(size)
    ]
    return b"".join(v.to_bytes(2, "little") for v in values), values


def test_psnr_of_planes_and_arrays_agree(spark):
    (one, x), (two, y) = planes_of(3), planes_of(4)
    df = spark.createDataFrame(
        [(bytearray(one), bytearray(two), x, y), (bytearray(one), bytearray(one), x, x), (bytearray(one), bytearray(two[:-2]), x, y[:-1]), (bytearray(one), None, x, None)],
        "a binary, b binary, x array<int>, y array<int>",
    )
    from clipledger.functions.arrow import psnr_planes

    rows = df.select(psnr_planes("a", "b").alias("p"), V.psnr("x", "y").alias("q")).collect()
    mse = sum((i - j) ** 2 for i, j in zip(x, y)) / len(x)
    assert math.isclose(rows[0].p, 10 * math.log10(65535**2 / mse))
    assert math.isclose(rows[0].p, rows[0].q)
    assert [(r.p, r.q) for r in rows[1:]] == [(99.0, 99.0), (0.0, 0.0), (None, None)]


def test_planar_layout(spark):
    flat, values_ = planes_of(1, 4, 2)
    mixed = b"".join(values_[p * 8 + i].to_bytes(2, "little") for i in range(8) for p in range(3))
    df = spark.createDataFrame([("a", 0, bytearray(mixed))], "clip_id string, frame_no bigint, planes binary")
    assert bytes(V.to_planar(df).first().planes) == flat


def test_gate(spark):
    frame = lambda n: bytearray(planes_of(n)[0])
    near = bytearray(frame(2))
    near[0] ^= 1
    schema = "clip_id string, frame_no bigint, planes binary"
    a = [("same", n, frame(n)) for n in range(5)] + [("near", n, frame(2)) for n in range(2)]
    b = [("same", n, frame(n)) for n in (0, 2, 4)] + [("near", 0, near), ("near", 1, frame(12))]
    a += [("hole", n, frame(n)) for n in range(3)]
    b += [("hole", n, frame(n)) for n in (0, 2)]
    clips = spark.createDataFrame(
        [("same", 5), ("near", 2), ("hole", 3), ("empty", 0)], "clip_id string, frame_count bigint"
    )
    rows = {r.clip_id: r for r in V.gate(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), clips).collect()}
    assert (rows["same"].gated, rows["same"].worst_psnr, rows["same"]["pass"]) == (True, 99.0, True)
    assert rows["near"].gated and not rows["near"]["pass"] and rows["near"].worst_psnr < 55
    assert (rows["hole"].gated, rows["hole"].worst_psnr, rows["hole"]["pass"]) == (False, None, False)
    assert (rows["empty"].gated, rows["empty"].worst_psnr, rows["empty"]["pass"]) == (True, None, True)


def test_decode_path(spark):
    rows = [
        (2, True, True, True, 60.0, "cpu"), (0, False, False, False, None, "cpu"),
        (1, False, False, False, None, "error"), (1, True, False, False, None, "gpu"),
        (0, True, False, False, None, "cpu"), (0, True, True, True, 60.0, "gpu"),
        (0, True, True, True, None, "gpu"), (1, True, True, False, 40.0, "gpu"),
        (0, True, True, False, 40.0, "cpu"),
    ]
    df = spark.createDataFrame(rows, "decode_mode int, init_ok boolean, gated boolean, pass boolean, worst_psnr double, want string")
    out = V.decide_path(df).collect()
    assert [r.decode_path for r in out] == [r.want for r in out]
    assert len({r.decode_note for r in out}) == 9


def test_quality(spark):
    lines = spark.createDataFrame(
        [("a", "n:1 mse_avg:0.00 psnr_avg:inf psnr_y:1"), ("a", "n:2 psnr_avg:40.00"), ("a", "x All:inf (inf)"),
         ("a", "n:1 Y:0.9 All:0.990000 (20)"), ("b", "psnr_avg:-inf"), ("b", "nothing"), ("c", "nothing")],
        "clip_id string, line string",
    )
    log = Q.parse_quality_log(lines)
    pooled = {r.clip_id: (r.frames, r.psnr, r.ssim) for r in Q.pool_quality(log, ["clip_id"]).collect()}
    assert pooled == {"a": (2, 70.0, 0.995), "b": (1, 0.0, None), "c": (0, None, None)}
    worst = {r.clip_id: (r.worst_psnr, r["pass"]) for r in Q.worst_frame(log).collect()}
    assert worst == {"a": (40.0, False), "b": (float("-inf"), False), "c": (None, False)}
    runs = spark.createDataFrame(
        [("v", 1, 96.0, None, None), ("w", 1, 94.0, None, None), ("w", 2, 95.0, None, None),
         ("p", 1, None, 43.0, 0.96), ("p", 2, None, 42.0, 0.969), ("q", 1, None, 41.0, 0.99)],
        "clip_id string, attempt int, vmaf double, psnr double, ssim double",
    )
    got = {r.clip_id: (r.needs_retry, r.retried, r.verdict) for r in Q.quality_verdict(runs).collect()}
    assert got == {"v": (False, False, "PASS"), "w": (True, True, "PASS"), "p": (True, True, "FAIL"), "q": (True, False, "FAIL")}


def test_states(spark):
    names = {"fresh": [], "part_only": ["part"], "ready": ["part", "samples", "ckpt"],
             "empty": ["part", "samples", "ckpt"], "back": ["part_old", "samples", "ckpt"],
             "shell": ["part", "part_old", "samples", "ckpt"], "other": ["part", "samples", "ckpt"]}
    files = [(k, kind) for k, kinds in names.items() for kind in ["output", *kinds]]
    matches = spark.createDataFrame(
        [("ready", True), ("empty", True), ("back", True), ("shell", True), ("other", False), ("lost", True)],
        "clip_key string, usable boolean",
    )
    progress = spark.createDataFrame([("ready", 60), ("shell", 0), ("empty", 0)], "clip_key string, resume_frame bigint")
    out = P.artifact_state(spark.createDataFrame(files, "clip_key string, kind string"), matches, progress)
    assert {r.clip_key: r.state for r in out.collect()} == {
        "fresh": "FRESH", "part_only": "REJECT", "ready": "RESUMABLE", "empty": "FRESH",
        "back": "ROLL_BACK", "shell": "ROLL_BACK", "other": "REJECT", "lost": "FRESH",
    }


def test_checkpoint_rules(spark):
    now = spark.createDataFrame(
        [(k, "2", "in", "h", "s") for k in "abcdef"], "clip_key string, tool_version string, input string, sha256 string, settings_hash string"
    )
    cks = spark.createDataFrame(
        [("a", "2", "in", "h", "s"), ("b", "2", "in", "", "s"), ("c", "2", "in", "old", "s"),
         ("d", "2", "in", "h", "crf18"), ("e", "1", "in", "h", "s"), ("f", "2", "moved", "h", "s"), ("g", "2", "in", "h", "s")],
        "clip_key string, toolVersion string, input string, sourceSha256 string, settingsHash string",
    )
    got = {r.clip_key: (r.status, r.usable) for r in P.match_checkpoints(cks, now).collect()}
    assert got == {
        "a": ("match", True), "b": ("unverified", True), "c": ("source changed", False),
        "d": ("other settings", False), "e": ("other version", False), "f": ("other input", False),
        "g": ("no source", False),
    }


def test_pending_and_hash_check_with_a_hot_source(spark, no_broadcast):
    sources = spark.createDataFrame(
        [(f"/in/{i}.NEV", True) for i in range(6)] + [("/in/0.nev", True), ("/in/dir.NEV", False)],
        "path string, is_regular boolean",
    )
    found = P.classify(spark.createDataFrame(
        [("/in/0.h265.mov",), ("/in/0.h265.mov.sidecar.json",), ("/in/1.h265.mov",), ("/in/2.h265.mov.sidecar.json",)], "path string"
    ))
    got = {r.path: r.reason for r in P.pending(sources, found).collect()}
    assert got == {"/in/1.NEV": "no sidecar", **{f"/in/{i}.NEV": "new" for i in (2, 3, 4, 5)}}
    forced = {r.path: r.reason for r in P.pending(sources, found, True).collect()}
    assert forced["/in/0.NEV"] == forced["/in/0.nev"] == "forced" and "/in/dir.NEV" not in forced
    clash = P.name_collisions(sources.filter("is_regular")).collect()
    assert [(r.clip_key, r.sources) for r in clash] == [("/in/0.h265.mov", 2)]

    hashes = spark.createDataFrame([("/in/hot.NEV", "h"), ("/out/n.NEV", "x")], "path string, sha256 string")
    cars = [(f"/out/{i}.mov", "h" if i % 2 else "no", ["/in/hot.NEV", None]) for i in range(40)]
    cars += [("/out/n.mov", "x", ["/gone/n.NEV"]), ("/out/g.mov", "x", ["/gone/g.NEV"]), ("/out/z.mov", None, ["/in/hot.NEV"])]
    cars += [("/out/two.mov", "x", ["/in/hot.NEV", "n.NEV"])]
    rows = C.verify_source_hash(spark.createDataFrame(cars, "path string, sha256 string, candidates array<string>"), hashes)
    got = {r.path: r.status for r in rows.collect()}
    assert {got[f"/out/{i}.mov"] for i in range(1, 40, 2)} == {"pass"}
    assert {got[f"/out/{i}.mov"] for i in range(0, 40, 2)} == {"fail"}
    assert (got["/out/n.mov"], got["/out/g.mov"], got["/out/z.mov"], got["/out/two.mov"]) == ("pass", "not found", "no hash", "pass")


def test_archive_rules_on_a_sidecar(spark):
    text = json.dumps({"sha256": "ab", "matrix": "x", "decode_path": "gpu", "gpu_device": None, "gate_psnr_db": None, "encode": {"crf": 14, "keyint": 120}})
    stream = dict(codec_name="hevc", profile="Main 10", pix_fmt="yuv420p10le", color_space="bt2020nc", color_range="pc", r_frame_rate=None, width=640, height=360, sample_rate=None, channels=None)
    from clipledger.schemas import PROBE

    probe = spark.createDataFrame([("a.mov", [stream]), ("b.mov", [])], PROBE)
    cars = C.read_sidecar_text(spark.createDataFrame([("a.mov", text)], "path string, text string"))
    rows = C.verify_archives(C.stream_summary(probe), cars)
    a = {r.rule: r.status for r in rows.filter("path = 'a.mov'").collect()}
    assert [k for k, v in a.items() if v == "fail"] == ["gpu device"]
    assert a["sample rate"] == "info" and a["gate value"] == "pass"
    verdicts = {r.path: (r.failed_rules, r.verdict) for r in C.verdict(rows).collect()}
    assert verdicts == {"a.mov": (1, "FAIL"), "b.mov": (7, "FAIL")}
    checked = spark.createDataFrame([("a.mov", "fail"), ("b.mov", "not found")], "path string, status string")
    assert sorted(r.status for r in C.hash_rules(checked).collect()) == ["fail", "info"]
