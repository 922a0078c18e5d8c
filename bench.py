"""Headline queries at one scale factor: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from clipledger.session import build_session

HEADLINE = [
    "packet_offsets",
    "complete_count",
    "resume_point",
    "resume_point_rough",
    "resume_report",
    "purge_reorder",
    "monotone_dts",
    "cadence",
    "frame_duration",
    "audio_index",
    "audio_align",
    "audio_interleave",
    "frame_psnr",
    "decode_gate",
    "quality_pool",
    "archive_rules",
    "source_hash_check",
    "ordered_dedup",
    "release_prefix",
    "settings_violations",
    "sample_log_round_trip",
    "checkpoint_stream",
]


def seconds(function) -> float:
    begin = time.perf_counter()
    function()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__log__level="OFF",
        spark__ui__showConsoleProgress="false",
    )
    from clipledger.catalog import QUERIES
    from clipledger.plans import tables

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {"samples_table": seconds(lambda: tables.samples(spark, sf_dir))}
    for name in os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        times[name] = min(seconds(run) for _ in range(2))
    spark.stop()
    times = {k: round(v, 3) for k, v in times.items()}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
