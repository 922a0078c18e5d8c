"""Random logs for the loop models, and the synthetic clip."""

from __future__ import annotations

import random

from clipledger.schemas import SAMPLES

DEN = 10


def random_log(rng: random.Random, clip: str, n: int) -> list[dict]:
    """A log with out-of-order frames, late and early dts, empty packets and lost key frames."""
    rows, frame = [], 0
    slack = rng.choice([0, 1, 2, 5])
    early = rng.random() < 0.6
    for seq in range(n):
        video = rng.random() < 0.8
        size = rng.choice([0, -3, 1, 2, 5, 9, 20])
        if video:
            number = max(frame + rng.randint(-2, 2), -1 if rng.random() < 0.05 else 0)
            dts = (frame - rng.choice([2, 3, 4]) if early else frame) * DEN + slack * rng.randint(0, 9)
            frame += 1 if rng.random() < 0.9 else 0
            row = dict(pts=number * DEN, dts=dts, is_key=rng.random() < 0.2, frame_no=number)
        else:
            row = dict(pts=seq * 8, dts=seq * 8, is_key=True, frame_no=-1)
        rows.append(dict(clip_id=clip, seq=seq, is_video=video, size=size, **row))
    return rows


def random_archive(seed: int, clips: int = 120, longest: int = 60) -> dict[str, list[dict]]:
    rng = random.Random(seed)
    return {
        f"c{i}": random_log(rng, f"c{i}", rng.randint(1, longest)) for i in range(clips)
    }


def frame_of(spark, archive: dict[str, list[dict]]):
    names = [part.strip().split()[0] for part in SAMPLES.split(",")]
    rows = [tuple(r[c] for c in names) for log in archive.values() for r in log]
    return spark.createDataFrame(rows, SAMPLES).repartition(3)


def by_clip(df, *columns):
    out: dict[str, list] = {}
    for row in df.collect():
        out.setdefault(row["clip_id"], []).append(tuple(row[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}
