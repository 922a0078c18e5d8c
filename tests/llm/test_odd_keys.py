"""Rows without a doc_id or vec_id, and rows that share one, in the training-data operators."""

import collections
import random
import uuid

import numpy as np

from clipledger.llm import crosspolytope, mixing, substring
from tests.llm.test_operators import DOCS, WORD


def brute_removed(rows):
    lowest, out = {}, []
    order = [float("inf") if r[0] is None else r[0] for r in rows]
    texts = [WORD.findall(r[1] or "") for r in rows]
    for doc, words in zip(order, texts):
        for i in range(len(words) - 12):
            window = tuple(words[i : i + 13])
            lowest[window] = min(lowest.get(window, doc), doc)
    for row, doc, words in zip(rows, order, texts):
        gone = {j for i in range(len(words) - 12) if lowest[tuple(words[i : i + 13])] < doc for j in range(i, i + 13)}
        out.append((row[0], len(words), len(gone)))
    return collections.Counter(out)


def test_substring_with_thousands_of_null_ids(spark):
    """Many rows share a key of few bits: hits of one text are not taken for another's."""
    rng = random.Random(2)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.choice([14, 30, 60]))] for _ in range(40)]
    rows = []
    for i in range(10_000):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20))]
        words += rng.choice(passages) + [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20))]
        rows.append((None if i % 3 else i % 400, " ".join(words), "en", "a", 1))
    found = substring.substring_dedup(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in found) == brute_removed(rows)


def test_hits_of_another_text_are_left_out():
    words = np.arange(40, dtype=np.uint64) * np.uint64(977)
    runs = substring.run_hashes(words, substring.ANCHOR, 1)
    key = runs[5:6].view(np.int64)
    hit = np.array([5 << 16 | 1])
    assert substring.covered(words, hit, key).sum() == 13
    assert not substring.covered(words, hit, key + 1).any()
    assert not substring.covered(words[:8], np.array([30 << 16 | 1]), key).any()
    assert not substring.covered(words[:0], hit, key).any()


def test_vectors_that_share_a_vec_id(spark):
    """One vec_id with two vectors: each links with its own neighbour, and they are one node."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        one, two = rng.normal(size=(2, 16))
        near = [v + rng.normal(size=16) * 0.01 for v in (one, two)]
        rows += [(10 * i + 5, one), (10 * i + 5, two), (10 * i + 3, near[0]), (10 * i + 7, near[1])]
    data = [(i, [float(x) for x in v], 1) for i, v in rows]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    got = collections.Counter(map(tuple, crosspolytope.near_vectors(vectors).collect()))
    want = collections.Counter()
    for i in range(200):
        for vec in (10 * i + 5, 10 * i + 5, 10 * i + 3, 10 * i + 7):
            want[vec, 1, 10 * i + 3, vec == 10 * i + 3] += 1
    assert got == want


def test_mixing_draws_rows_without_an_id_by_themselves(spark):
    rows = [(None, f"text {i}", "en", "ab"[i % 2], 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.replicate(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    found = {r.source: r["count"] for r in out}
    assert abs(found["a"] - 5000) < 350 and abs(found["b"] - 15_000) < 600


def test_tiny_weights_keep_their_ratio(spark):
    docs = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(2000)], DOCS)
    count = lambda w: sorted((r.source, r["count"]) for r in mixing.replicate(docs, w).groupBy("source").count().collect())
    assert count({"a": 1e-10, "b": 1e-10}) == count({"a": 2.0, "b": 2.0})
    assert [s for s, _ in count({"a": 1e-15, "b": 0.0})] == ["a"] and count({"a": 0.0, "b": 0.0}) == []


def test_no_group_of_fingerprints_is_above_two_blocks(spark, monkeypatch, tmp_path):
    """One large shard: its blocks meet in pairs, and the links connect what brute force connects."""
    from clipledger.llm import simhash
    from clipledger.llm.common import components

    rng = random.Random(4)
    near = [rng.getrandbits(12) for _ in range(500)]
    values = sorted({(n << 50) | rng.getrandbits(2) for n in near})
    monkeypatch.setattr(simhash, "TREE", 16)
    inner, folder = simhash._links, str(tmp_path)

    def sized(radius):
        run = inner(radius)

        def counted(batches):
            held = [b for b in batches if b.num_rows]
            for b in held:
                groups = collections.Counter(zip(*(b.column(k).to_pylist() for k in simhash._FACING)))
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(str(max(groups.values())))
            yield from run(iter(held))

        return counted

    monkeypatch.setattr(simhash, "_links", sized)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    found = {r.node: r.root for r in components(simhash.fingerprint_links(fps, 3), "t").collect()}
    root = {v: v for v in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    groups = collections.defaultdict(set)
    for v in values:
        groups[top(v)].add(signed(v))
    got = collections.defaultdict(set)
    for v in values:
        got[found.get(signed(v), signed(v))].add(signed(v))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    # A block has TREE members on average.
    assert 16 < max(sizes) <= 4 * 16


def test_thousands_of_repeated_rows_in_line_dedup(spark):
    """Repeats of one row share its key: the time follows their number."""
    import time

    from clipledger.llm import linechunks

    text = "\n".join(f"line {i} of a text that others have too" for i in range(60))
    seconds = []
    for n in (500, 1000, 4000):
        rows = [(1, text, "en", "a", 1)] * n + [(2, text, "en", "a", 1)]
        began = time.time()
        out = linechunks.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
        seconds.append(time.time() - began)
        assert {r.n_removed_lines == 0 for r in out if r.doc_id == 1} == {True}
        assert all(r.n_removed_lines > 30 for r in out if r.doc_id == 2)
    assert seconds[2] < 4 * seconds[1] + 5
