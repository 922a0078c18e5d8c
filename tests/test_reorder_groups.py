"""The reorder buffer over many clips, which meet in the state by groups."""

import random

import pytest

from clipledger.streaming import keyed as K
from tests.test_keyed_streams import at, feed

SCHEMA = "clip_id bigint, n bigint, ts timestamp"


def test_clips_of_a_group_share_a_call_and_a_timer(spark):
    """Each clip was a key of its own, with a call and a timer, so 90,000 clips made as many of both."""
    rows = [(clip, n, at(n)) for clip in range(3000) for n in (0, 2)]
    stream = K.keyed_reorder(spark, timeout_s=10)
    folder = f"{stream.folder}/feed"
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
    query = stream.start(spark.readStream.schema(SCHEMA).parquet(folder))
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    timers = sum(s["customMetrics"]["numRegisteredTimers"] for s in states)
    assert 0 < timers <= K.BUCKETS
    assert sorted(tuple(r) for r in stream.result().collect()) == [(c, 0, "released") for c in range(3000)]
    feed(spark, stream, [spark.createDataFrame([(0, 0, at(99))], SCHEMA)])
    # Fed from another folder, the first rows do not come again: all gaps are told, each once.
    gaps = stream.result().filter("event = 'gap'").collect()
    assert sorted((r.clip_id, r.n) for r in gaps) == [(c, 1) for c in range(3000)]


def told_by(parts, timeout):
    """A loop over batches: each number once it is due, and the gaps after the time before and the time of each."""
    due, held, told, out, now = {}, {}, {}, [], 0
    for part in parts:
        before = now
        for clip, n, second in part:
            due.setdefault(clip, 0)
            now = max(now, second)
            if n >= due[clip]:
                mine = held.setdefault(clip, {})
                mine[n] = min(mine.get(n, second), second)
        for clip, mine in held.items():
            while due[clip] in mine:
                mine.pop(due[clip])
                out.append((clip, due[clip], "released"))
                due[clip] += 1
        for time in (before, now):
            for clip, mine in held.items():
                if mine and told.get(clip) != due[clip] and time - min(mine.values()) > timeout:
                    told[clip] = due[clip]
                    out.append((clip, due[clip], "gap"))
    return sorted(out)


@pytest.mark.parametrize("pass_rows", [0, 1 << 30])
def test_groups_over_batches_equal_loops(spark, monkeypatch, pass_rows):
    """Runs come, grow, meet, move to other places and go, with the state read by key and in passes."""
    monkeypatch.setattr(K, "BUCKETS", 3)
    monkeypatch.setattr(K, "PASS_ROWS", pass_rows)
    rng = random.Random(17)
    numbers = {c: rng.sample(range(40), 38) + rng.choices(range(40), k=4) for c in range(12)}
    parts, second = [], 0
    for _ in range(6):
        part = []
        for clip, line in numbers.items():
            for _ in range(rng.choice((0, 3, 7, 14))):
                if line:
                    second += rng.choice((0, 0, 1))
                    part.append((clip, line.pop(), second - rng.choice((0, 0, 30))))
        parts.append(part)
        second += rng.choice((5, 40))
    frames = [spark.createDataFrame([(c, n, at(s)) for c, n, s in part], SCHEMA) for part in parts]
    got = sorted(tuple(r) for r in feed(spark, K.keyed_reorder(spark, timeout_s=45), frames).collect())
    want = told_by(parts, 45)
    assert got == want and {event for _, _, event in want} == {"released", "gap"}
