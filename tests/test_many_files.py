"""Many small files: writing, listing and reading by tasks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from clipledger.sources import archive as A
from clipledger.sources import documents as D
from clipledger.sources import listing
from clipledger.sources import samplelog


def test_a_small_table_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table in one partition stands for many files; each task leaves the mark of its process."""
    write = D.WholeFilesWriter.write

    def marked(self, iterator):
        from pyspark import TaskContext

        rows = list(iterator)
        with open(f"{tmp_path}/task-{TaskContext.get().partitionId()}", "w") as out:
            out.write(str(len(rows)))
        return write(self, iter(rows))

    monkeypatch.setattr(D.WholeFilesWriter, "write", marked)
    rows = spark.range(0, 700, 1, 1).select(
        F.concat(F.lit(f"{tmp_path}/many/"), "id", F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("content")
    )
    D.write_files(rows)
    assert sorted(int(open(f"{tmp_path}/many/{n}").read()) for n in os.listdir(f"{tmp_path}/many")) == list(range(700))
    counts = [int((tmp_path / n).read_text()) for n in os.listdir(tmp_path) if n.startswith("task-")]
    assert sum(counts) == 700 and max(counts) < 350


def test_a_failed_group_names_no_file(tmp_path):
    class Row:
        def __init__(self, path, content):
            self.path, self.content = path, content

    def rows():
        yield Row(f"{tmp_path}/a/1", b"one")
        raise RuntimeError("torn")

    with pytest.raises(RuntimeError, match="torn"):
        D.WholeFilesWriter().write(rows())
    assert not [n for n in os.listdir(tmp_path / "a") if ".tmp-" not in n]
    again = [Row(f"{tmp_path}/a/{i % 300}", str(i).encode()) for i in range(1000)]
    assert D.WholeFilesWriter().write(iter(again)).count == 1000
    assert (tmp_path / "a" / "7").read_bytes() == b"907"


def test_small_files_read_in_few_tasks(spark, tmp_path):
    """Spark's file source made one task per 32 small files."""
    for i in range(400):
        folder = tmp_path / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"c {i}%20+é.sidecar.json").write_text(json.dumps({"source": f"s{i}", "frame_count": i}, indent=1))
    (tmp_path / "d0" / ".hidden.sidecar.json").write_text('{"source": "no"}')
    (tmp_path / "d0" / "_made.sidecar.json").write_text('{"source": "no"}')
    (tmp_path / "d0" / "_k=1.sidecar.json").write_text('{"source": "yes"}')
    (tmp_path / "d0" / "empty.sidecar.json").write_text("")
    (tmp_path / "d0" / "torn.sidecar.json").write_text('{"source": "s')
    found = D.read_sidecars(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism)
    rows = {r.clip_key: (r.source, r.frame_count) for r in found.collect()}
    assert len(rows) == 402 and rows[f"{tmp_path}/d1/c 4%20+é"] == ("s4", 4)
    assert rows[f"{tmp_path}/d0/_k=1"] == ("yes", None) and rows[f"{tmp_path}/d0/torn"] == (None, None)
    told = A.scan_artifacts(spark, str(tmp_path))
    assert told.rdd.getNumPartitions() < 12
    facts = os.stat(f"{tmp_path}/d1/c 4%20+é.sidecar.json")
    one = told.filter(F.col("path").endswith("/c 4%20+é.sidecar.json")).first()
    assert one.length == facts.st_size and one.kind == "sidecar"
    ms = listing.list_files(spark, f"{tmp_path}/d1").filter(F.col("path").endswith("/c 4%20+é.sidecar.json")).first()
    assert ms.modified_ms == facts.st_mtime_ns // 1_000_000


def test_checkpoint_lines(spark, tmp_path):
    good = json.dumps(dict(version=1, toolVersion="t", sourceSha256="", settingsHash="s", videoFrames=1, audioEndSample=2, totalFrames=3))
    (tmp_path / "a.ckpt").write_bytes(f"{good}\r\n \n{good[:-4]}\n".encode())
    (tmp_path / "b.ckpt").write_bytes(b"")
    rows = D.read_checkpoints(spark, str(tmp_path))
    assert rows.columns[-2:] == ["clip_key", "is_valid"]
    assert sorted((r.clip_key, r.is_valid) for r in rows.collect()) == [(f"{tmp_path}/a", False), (f"{tmp_path}/a", True)]


def test_powers_are_made_once_for_all_clips():
    import numpy as np

    samplelog._powers.cache_clear()
    rng = random.Random(4)
    bases = (rng.randrange(1 << 16, samplelog.PRIME), rng.randrange(1 << 16, samplelog.PRIME))
    for n in range(1, 300):
        count, *rest = samplelog._numbering(np.arange(n), bases)
        assert count == n and rest[0] % samplelog.PRIME == sum(pow(bases[0], i, samplelog.PRIME) for i in range(n)) % samplelog.PRIME
    assert samplelog._powers.cache_info().misses == 2
