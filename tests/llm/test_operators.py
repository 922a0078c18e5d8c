"""The training-data operators against brute force, and on tables of odd rows."""

import collections
import gzip
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clipledger.llm import (
    crosspolytope,
    linechunks,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    toxicity,
    warczip,
)
from clipledger.llm.common import components
from clipledger.llm.queries import QUERIES, VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    body = "\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(8))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t \r\n", "en", "a", 5),
        (4, long, "en", "a", None),
        (5, long, "en", "b", None),
        (5, long, "en", "b", None),
        (6, body, "en", None, 1),
        (6, body + "\nand more of it at the end", "en", "b", 1),
        (7, body, "en", "a", 1),
        (7, body, "en", "a", 1),
        (None, body, "en", "a", 1),
        (None, "alone " * 60, "en", "a", 1),
        (None, None, "en", "a", 1),
        (8, "x" * 5000, "en", "a", 1),
        (9, "Äö ß 漢字 🙂 <|endoftext|> a  b\n\nc ", "de", "a", 1),
        (10, "a a a a a a a a a a a a a a a a a a a a", "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clashing(df):
    """The same rows with columns named like the ones operators add."""
    names = "hits tag doc n_words host source_x rate copy shuffle_key n_lines kept _part _idx h1 root low fp".split()
    return df.withColumns({n: F.lit("x") for n in names})


# --- components --------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000 + i, 999) for i in range(50)]
    edges += [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {n: top(n) for n in root if top(n) != n}
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "t")
    assert {r.node: r.root for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0


# --- 1 packing -----------------------------------------------------------------------------------


def brute_pieces(rows, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(found, rows):
    assert sorted([tuple(r)[:5] for r in found], key=str) == brute_pieces(rows)
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r.length for r in found)


@pytest.mark.parametrize("clash", [False, True])
def test_packing_odd(odd, clash):
    docs = clashing(odd) if clash else odd
    check_packed(packing.pack(docs, VOCABULARY).collect(), [r[:2] for r in odd_rows()])


def test_packing_documents(spark, sf_dir, documents):
    found = QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    bins, tokens = check_packed(found, [(r.doc_id, r.text) for r in documents.collect()])
    assert bins <= -(-tokens // 1024) * 1.02 + 1


def test_packed_ids(spark, odd):
    """The ids themselves are the output: pieces have theirs, and those of a sequence make it up."""
    found = packing.pack(odd, VOCABULARY)
    rows = found.collect()
    encoder = packing.WordEncoder(VOCABULARY)
    end = np.array([packing.END_ID], "<u4").tobytes()
    want = [(r[0], encoder.encode([r[1] or ""])[0] + end) for r in odd_rows()]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    whole = {doc: raw for doc, raw in want if doc in (1, 2, 3, 4, 8, 9, 10)}
    for doc, raw in whole.items():
        assert b"".join(r.ids for r in sorted(rows, key=lambda r: r.start) if r.doc_id == doc) == raw
    assert sum(len(r.ids) for r in rows) == sum(len(raw) for _, raw in want)
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(found).collect()}
    assert set(made) == {r.sequence_id for r in rows}
    for r in rows:
        assert made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert sum(map(len, made.values())) == sum(len(raw) for _, raw in want)
    assert packing.sequences(packing.pack(odd.limit(0), VOCABULARY)).count() == 0


def test_pipeline_ends_in_ids(spark, odd, sf_dir):
    import corpus_pipeline

    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir)
    assert all(len(r.ids) == 4 * r.length for r in packed.collect())


def test_packing_empty(odd):
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


def test_minimum_slack_is_greedy_per_bin():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([10, 17, 30])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 25)))
        left = dict(counts)
        for content, times in packing.minimum_slack(dict(counts), capacity):
            longest = max(k for k, n in left.items() if n)
            assert max(dict(content)) == longest
            for _ in range(times):
                sums = {0}
                for length, n in left.items():
                    for _ in range(n - (length == longest)):
                        sums |= {s + length for s in sums if s + length <= capacity - longest}
                assert sum(length * k for length, k in content) == longest + max(sums)
                for length, k in content:
                    left[length] -= k
                    assert left[length] >= 0
        assert not any(left.values())


def test_word_encoder():
    encoder = packing.WordEncoder(VOCABULARY)
    rng = random.Random(8)
    parts = ["a", "Bc", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "!", "9", "<|endoftext|>", "漢", "\x1c", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for begin in range(0, len(texts), 100):
        some = texts[begin : begin + 100]
        for text, raw in zip(some, encoder.encode(some), strict=True):
            ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert raw == np.array(ids, "<u4").tobytes()


# --- 2 quality -----------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


@pytest.mark.parametrize("clash", [False, True])
def test_quality_odd(odd, clash):
    found = quality.quality_rules(clashing(odd) if clash else odd).collect()
    got = sorted([(r.doc_id, *[r[n] for n in quality.STATISTICS]) for r in found], key=str)
    assert got == sorted([(r[0], *brute_base(r[1])) for r in odd_rows()], key=str)
    assert all(not r.kept for r in found if r.base_failed)
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_boilerplate(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    short = "Read more on our pages"
    rows = [(i, f"{fresh(60)}\n{short}", "en", "h", 0) for i in range(30)]
    rows += [(100 + i, "\n".join([f"  READ  more on OUR pages{i % 2 * ' '}"] * 30), "en", "h", 0) for i in range(3)]
    copy = fresh(20) + "\n" + fresh(70)
    rows += [(200 + i, copy, "en", "h", 0) for i in range(40)]
    rows += [(300, f"{fresh(60)}\n{short}", "en", "other", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    verdict = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(verdict[i].kept and verdict[i].n_kept_words == 60 for i in range(30))
    assert verdict[300].n_kept_words == 65
    assert all(verdict[200 + i].kept and verdict[200 + i].n_kept_words == 90 for i in range(40))
    left = {r.doc_id: r.text for r in quality.apply_quality(docs).collect()}
    assert short not in left[0] and short in left[300] and 100 not in left and left[200] == copy


# --- 3 toxicity ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark, documents):
    rng = random.Random(4)
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumblax", "stinkor", "idiotron", "morbozo"]
    hide = lambda w: rng.choice(
        [w, w.replace("o", "0").replace("i", "1"), " ".join(w), w.replace("o", "oooo"), ".".join(w)]
    )
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [word() for _ in range(80)]
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), hide(w))
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = toxicity.score_toxicity(docs, truth, with_text=True).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert right / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)


def test_toxicity_never_learns_held_out(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: sorted(tuple(r) for r in toxicity.score_toxicity(documents, x).collect())
    assert scores(labels) == scores(flipped)


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd_labels = spark.createDataFrame(
        [(None, 1, 1), (5, 1, None), (4, 0, 1), (4, 0, 0), (6, 1, 0), (7, 1, 0), (8, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    for labels in (none, odd_labels):
        found = toxicity.score_toxicity(clashing(odd), labels).collect()
        assert len(found) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_toxicity(odd.limit(0), none).count() == 0


# --- 4 sharding ----------------------------------------------------------------------------------


@pytest.mark.parametrize("clash", [False, True])
def test_sharding_odd(odd, clash):
    found = sharding.interleave(clashing(odd) if clash else odd, shards=3).collect()
    want = [
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()
    ]
    assert sorted([tuple(r)[:3] for r in found], key=str) == sorted(want, key=str)
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (5, 6)
    assert sharding.interleave(odd.limit(0)).count() == 0


def test_sharding_mixture(spark):
    docs = spark.range(3000).selectExpr(
        "id doc_id", "'t' text", "'en' lang", "case when id % 3 = 0 then 'hot' else concat('s', id % 4) end source"
    )
    found = sharding.interleave(docs).join(docs, "doc_id").groupBy("shard", "source").count().collect()
    sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert all(abs(r["count"] - sizes[r.source] / 16) <= 2 for r in found)


@pytest.mark.parametrize("clash", [False, True])
def test_sharded_documents(odd, clash):
    """The shards hold whole documents, in the places that the digests tell."""
    docs = (clashing(odd) if clash else odd).withColumn("slot", F.lit("x"))
    found = sharding.shard_documents(docs, shards=3)
    assert found.columns == [*docs.drop("slot").columns, "shard", "slot"]
    rows = found.collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(odd_rows(), key=str)
    assert len({(r.shard, r.slot) for r in rows}) == len(odd_rows())
    told = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in sharding.interleave(docs, shards=3).collect()}
    # Equal rows may change places; their digests are equal.
    assert told == {(r.shard, r.slot): (r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows}


# --- 5 vectors -----------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.98):
    unit, links = [], [0] * len(rows)
    root = list(range(len(rows)))
    for _, e, label in rows:
        ok = e is not None and label is not None and len(e) and None not in e and np.isfinite(e).all() and any(e)
        unit.append(np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if ok else None)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)].append(r[0])
    return sorted(
        [
            (r[0], links[i], None if r[0] is None else min(low[top(i)]), r[0] is not None and r[0] == min(low[top(i)]))
            for i, r in enumerate(rows)
        ],
        key=str,
    )


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=24)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, (centre + rng.normal(size=24) * rng.choice([0.02, 0.12, 0.2])).tolist(), label))
                n += 1
    centre = rng.normal(size=24)
    for _ in range(80):  # more than a block
        rows.append((n, (centre + rng.normal(size=24) * 0.05).tolist(), 1))
        n += 1
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(30)]
    n += 30
    rows += [
        (n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None] + [1.0] * 23, 1),
        (n + 4, rows[3][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1),
        (n + 8, [float("inf")] + [1.0] * 23, 1), (None, rows[0][1], rows[0][2]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = crosspolytope.near_vectors(clashing(df)).collect()
    got, want = sorted([tuple(r) for r in found], key=str), brute_vectors(rows)
    recall = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert recall >= 0.99 and all(a[1] <= b[1] for a, b in zip(got, want))
    if recall == 1:
        assert got == want
    assert crosspolytope.near_vectors(df.limit(0)).count() == 0


# --- 6 substrings --------------------------------------------------------------------------------


def brute_substrings(rows):
    order = lambda i: float("inf") if i is None else i
    docs = [(order(i), WORD.findall(t or ""), i) for i, t in rows]
    first = {}
    for i, words, _ in docs:
        for s in range(len(words) - 12):
            key = tuple(words[s : s + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words, doc in docs:
        gone = set()
        for s in range(len(words) - 12):
            if first[tuple(words[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_extend_across_batches(size):
    """Anchors cut by batches give the same windows as whole ones."""
    rng = np.random.default_rng(size)
    rows, want = [], set()
    for _ in range(400):
        low = int(rng.integers(0, 3))
        high = low + int(rng.integers(0, 3))
        signs = [int(rng.integers(0, 2)) for _ in range(low, high + 1)]
        rows.append((int(rng.integers(0, 12)), int(rng.integers(0, 40)), low, high, signs, bool(rng.integers(0, 9) == 0)))
    rows.sort(key=lambda r: r[:2])
    met = [
        (key, doc, left, sign)
        for key, doc, low, high, signs, decided in rows
        if not decided
        for left, sign in zip(range(high, low - 1, -1), signs)
    ]
    smallest = {}
    for key, doc, *content in met:
        smallest[key, *content] = min(doc, smallest.get((key, *content), doc))
    for place, (key, doc, low, high, signs, decided) in enumerate(rows):
        bits = 0
        for left, sign in zip(range(high, low - 1, -1), signs):
            if decided or doc > smallest[key, left, sign]:
                bits |= 1 << left
        if bits:
            want.add((doc, place, bits))
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([substring._pack(i, r[2], r[3], 0, r[5]) for i, r in enumerate(rows)], pa.int64()),
        pa.array([b"" if r[5] else b"".join(bytes([s] * substring.SIGN) for s in r[4]) for r in rows], pa.binary()),
    ]
    batch = pa.RecordBatch.from_arrays(columns, schema=substring._ROW)
    parts = [batch.slice(i, size) for i in range(0, len(rows), size)]
    got = [r for out in substring._extend([batch.slice(0, 0), *parts]) for r in out.to_pylist()]
    assert sorted((r["doc"], r["hit"] >> 16, r["hit"] & 0xFFFF) for r in got) == sorted(want)


@pytest.mark.parametrize("hot", [False, True])
def test_substrings(spark, odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring, "CELL_LEAST", 0)
        monkeypatch.setattr(substring, "CELL_TIMES", 0)
    rng = random.Random(11)
    words = [f"v{i}" for i in range(6)]
    passages = [[rng.choice(words) for _ in range(rng.randint(11, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [[rng.choice(words) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 20))] for _ in range(3)]
        for p in rng.sample(passages, 2):
            p = list(p)
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            parts.insert(1, p)
        rows.append((i % 100, " ".join(sum(parts, []))))
    plain = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], DOCS).repartition(5)
    got = sorted([tuple(r) for r in substring.substring_dedup(plain).collect()], key=str)
    assert got == brute_substrings(rows)
    got = sorted([tuple(r) for r in substring.substring_dedup(clashing(odd)).collect()], key=str)
    assert got == brute_substrings([r[:2] for r in odd_rows()])
    texts = substring.substring_dedup(odd, with_text=True)
    assert texts.columns[:4] == ["doc_id", "lang", "source", "n_chars"] and texts.count() == len(odd_rows())
    assert substring.substring_dedup(odd.limit(0)).count() == 0


# --- 7 line chunks -------------------------------------------------------------------------------


def brute_chunks(rows):
    value = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
    cut = {}
    for doc, text in rows:
        chunks, held, before = [], [], None
        for line in text.split("\n"):
            held.append(line)
            if before is not None and (before * 31 + value(line)) % 3 == 0:
                chunks.append(held)
                held = []
            before = value(line)
        cut[doc] = [*chunks, held] if held else chunks
    seen, out = set(), {}
    for doc in sorted(cut):
        kept = []
        for chunk in cut[doc]:
            body = "\n".join(chunk)
            eligible = len(chunk) > 1 and sum(bool(line.strip()) for line in chunk) > 1
            if eligible and body in seen:
                continue
            if eligible:
                seen.add(body)
            kept.append(body)
        out[doc] = "\n".join(kept)
    return out


def test_line_chunks(spark, odd):
    rng = random.Random(6)
    lines = [f"line {i}" for i in range(30)] + ["", " "]
    rows = []
    for i in range(80):
        text = [rng.choice(lines) for _ in range(rng.randint(1, 12))]
        begin = rng.randrange(10)
        text[1:1] = [f"shared {k}" for k in range(begin, begin + 12)]
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], DOCS)
    found = {r.doc_id: r for r in linechunks.dedup_lines(clashing(docs)).collect()}
    want = brute_chunks(rows)
    assert {i: r.text for i, r in found.items()} == want
    assert sum(r.n_removed_lines for r in found.values()) > 100
    got = linechunks.dedup_lines(odd)
    assert got.count() == len(odd_rows()) and linechunks.dedup_lines(odd.limit(0)).count() == 0
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0 and by[2][0].text == "" and by[2][0].n_lines == 1
    assert by[7][0].text == by[7][1].text


# --- 8 simhash -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)].append(r[0])
    return sorted([(r[0], f"{fps[i]:016x}", min(low[top(i)], default=None)) for i, r in enumerate(rows)], key=str)


def test_simhash(spark, sf_dir, documents, odd):
    found = QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=str)
    assert got == brute_classes([(r.doc_id, r.text) for r in documents.collect()])
    classes = simhash.near_classes(clashing(odd)).collect()
    got = sorted([(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in classes], key=str)
    assert got == brute_classes([r[:2] for r in odd_rows()])
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.root for r in classes})
    assert simhash.near_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_fingerprint_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: blocks)
    monkeypatch.setattr(simhash, "TREE", 4)
    rng = random.Random(blocks)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()

    def classes(edges):
        root = {v: v for v in signed}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {v: top(v) for v in signed}

    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert classes([tuple(r) for r in links]) == classes(near)


def test_bk_tree():
    rng = random.Random(9)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for _ in range(100):
        q = rng.getrandbits(12)
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


# --- 9 WARC --------------------------------------------------------------------------------------


def test_zip_parser(tmp_path, monkeypatch):
    for wide in (False, True):
        writer = warczip.ArchiveWriter(f"file://{tmp_path}/{wide}", zip64=wide)
        records = [warczip.warc_record(i, f"http://x/{i}\r\n", b"p" * i, "d", None) for i in range(5)]
        for i, r in enumerate(records):
            writer.add(i, r)
        path, size, count = writer.close()
        raw = open(path.removeprefix("file://"), "rb").read()
        assert len(raw) == size and count == 5
        found = warczip.read_index(io.BytesIO(raw), size)
        assert [gzip.decompress(raw[a : a + n]) for a, n in found] == records
        assert sorted(zipfile.ZipFile(io.BytesIO(raw)).namelist()) == sorted([warczip.DATA, warczip.INDEX])
    # Archives of another writer, with a comment that looks like an end record and forced ZIP64.
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"abc")
        z.writestr("b", b"defg")
        z.comment = b"PK\x05\x06 not the end"
    size = len(other.getvalue())
    members = warczip.read_members(other, size)
    assert [(m.name, m.size) for m in members] == [("a", 3), ("b", 4)]
    assert [other.getvalue()[warczip.member_place(other, m) :][: m.size] for m in members] == [b"abc", b"defg"]
    for broken in (b"", b"no archive at all"):
        with pytest.raises(ValueError):
            warczip.read_members(io.BytesIO(broken), len(broken))


def test_warc_odd(spark, monkeypatch):
    monkeypatch.setattr(warczip, "ARCHIVE_BYTES", 2000)
    big = "é" * 80
    rows = [
        (1, "u", big), (2, None, big), (3, "u v\n", "short"), (4, "u", "short"), (5, None, None), (6, "u", ""),
        (7, "u", big), (7, "u", big), (None, "u", big), (8, "u", "y" * 3_000_000), (9, "u", "WARC/1.1\r\n\r\n" * 20),
        (None, "u", "q" * 200), (None, "u", "q" * 200),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warczip.archive_pages(spark, clashing(df))
    found = warczip.read_archives(archives).collect()
    low = {}
    for page, _, html in rows:
        if page is not None:
            low[html] = min(low.get(html, page), page)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and html in low and page != low[html]
        want.append(
            (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low[html] if again else None)
        )
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.payload == (b"" if r.record_type == "revisit" else r.payload) for r in found)
    assert archives.count() > 1
    assert warczip.read_archives(warczip.archive_pages(spark, df.limit(0))).count() == 0


# --- 10 mixing -----------------------------------------------------------------------------------


def test_mixing_weights(spark, odd):
    docs = spark.range(40_000).selectExpr(
        "id doc_id", "'t' text", "case when id % 10 < 8 then 'hot' when id % 10 = 8 then 'b' else null end source"
    )
    found = mixing.replicate(docs, {"hot": 1.0, "b": 3.0}, total=20_000)
    counts = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert set(counts) == {"hot", "b"}
    assert abs(counts["hot"] - 5000) < 400 and abs(counts["b"] - 15000) < 700
    far = mixing.replicate(docs.filter("source = 'b'"), {"b": 1.0}, total=4000 * 30)
    times = [r["count"] for r in far.groupBy("doc_id").count().collect()]
    assert abs(np.mean(times) - 30) < 0.6 and abs(np.var(times) - 30) < 3
    keys = [r.shuffle_key for r in found.select("shuffle_key").collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("few", [0, 10_000])
def test_mixing_odd(spark, odd, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    found = mixing.replicate(clashing(odd), total=160)
    assert set(found.columns) == set(clashing(odd).columns)
    rows = found.collect()
    assert len(rows) > 80 and {r.source for r in rows} == {None, "a", "b"}
    copies = collections.Counter((r.doc_id, r.text, r.copy) for r in rows if r.doc_id == 5)
    assert set(copies.values()) <= {2}
    assert mixing.replicate(odd.limit(0)).count() == 0


def test_mixed_query_moves_whole_documents(spark, sf_dir, documents, monkeypatch):
    made = []

    def replicate(docs, *args, real=mixing.replicate, **named):
        made.append(real(docs, *args, **named))
        return made[-1]

    monkeypatch.setattr(mixing, "replicate", replicate)
    plan = QUERIES["op10_mixing"](spark, sf_dir)
    assert made[0].columns == [*documents.columns, "rate", "copy", "shuffle_key"]
    written = spark.read.parquet(*plan.inputFiles())
    assert set(written.columns) == set(made[0].columns)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = written.collect()
    assert len(rows) == plan.count() and all(r.text == texts[r.doc_id] for r in rows)
