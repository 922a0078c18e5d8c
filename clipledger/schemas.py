"""Explicit schemas of the tables. Readers never infer a schema."""

SAMPLES = (
    "clip_id string, seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, "
    "is_key boolean, frame_no bigint"
)
CHECKPOINT = (
    "version int, toolVersion string, input string, sourceSha256 string, settingsHash string, "
    "videoFrames bigint, audioEndSample bigint, totalFrames bigint"
)
SIDECAR = (
    "tool_version string, sdk_version string, source string, sha256 string, width bigint, "
    "height bigint, frame_count bigint, clip_frame_count bigint, fps string, "
    "audio struct<channels: int, sample_rate: int, bits: int>, color_space string, matrix string, "
    "lens_correction string, decode_path string, gpu_device string, gate_psnr_db double, "
    "decode_note string, "
    "applied struct<kelvin: double, tint: double, iso: bigint, exposure: double>, "
    "encode struct<codec: string, crf: int, preset: string, keyint: int, min_keyint: int, "
    "pools: int>, success boolean, meta array<array<string>>"
)
STREAM = (
    "struct<codec_name: string, profile: string, pix_fmt: string, color_space: string, "
    "color_range: string, r_frame_rate: string, width: int, height: int, sample_rate: int, "
    "channels: int>"
)
PROBE = f"path string, streams array<{STREAM}>"
ARTIFACTS = "path string, clip_key string, kind string, length bigint, modified timestamp"
FRAMES = "clip_id string, frame_no bigint, width int, height int, planes binary"
