"""Byte-string dedup against plain loops, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from clipledger.llm import suffixes
from clipledger.llm.queries import QUERIES
from tests.llm.test_operators import DOCS, clashing, odd_rows


def brute(rows):
    """Per row: (doc_id, n_bytes, n_removed, n_spans, digest, kept bytes)."""
    raws = [(t or "").encode() for _, t, *_ in rows]
    order = [float("inf") if d is None else d for d, *_ in rows]
    lowest = {}
    for doc, raw in zip(order, raws):
        for i in range(len(raw) - 49):
            piece = raw[i : i + 50]
            lowest[piece] = min(lowest.get(piece, doc), doc)
    out = []
    for row, doc, raw in zip(rows, order, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if lowest[raw[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        out.append((row[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(seed, docs=150, letters="ab c"):
    """Texts that share passages of all lengths, with changes of one sign, and few letters."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(rng.choice([49, 50, 51, 70, 120, 400])) for _ in range(12)]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randrange(5)):
            part = rng.choice(shared) if rng.random() < 0.7 else make(rng.randrange(90))
            if part and rng.random() < 0.3:
                at = rng.randrange(len(part))
                part = part[:at] + rng.choice("xé\0") + part[at + 1 :]
            text += part
        doc = rng.choice([None, rng.randrange(docs), i + 1000])
        rows.append((doc, text, "en", "a", 1))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return rows


def found(docs, **options):
    return collections.Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(docs, **options).collect()
    )


@pytest.mark.parametrize("letters", ["ab c", "abcdefghijklmnop qrstuvw", "a\0"])
def test_against_loops(spark, letters):
    rows = passages(len(letters), letters=letters)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(docs) == collections.Counter(r[:5] for r in brute(rows))


def test_odd_rows(spark, no_broadcast):
    rows = odd_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    assert found(docs) == collections.Counter(r[:5] for r in brute(rows))
    assert suffixes.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    whole = suffixes.suffix_dedup(docs, with_text=True)
    assert whole.columns == [*(c for c in docs.columns if c != "kept"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
    want = collections.Counter((r[0], row[1], r[5]) for r, row in zip(brute(rows), rows))
    assert collections.Counter((r.doc_id, r.text, bytes(r.kept)) for r in whole.collect()) == want


def test_hot_seeds_and_blocks(spark, monkeypatch):
    """Every seed hot, texts in blocks of some windows, anchors sent in small lots: the same rows."""
    rows = passages(7, docs=120)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(suffixes, "HOT_LEAST", 3)
    monkeypatch.setattr(suffixes, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(suffixes, "BLOCK", 130)
    monkeypatch.setattr(suffixes, "GATHERED", 50)
    shared = suffixes.shared_seeds(suffixes_input(docs))
    assert len(suffixes.hot_seeds(shared)) > 10
    assert found(docs) == collections.Counter(r[:5] for r in brute(rows))


def suffixes_input(docs):
    from pyspark.sql import functions as F

    return docs.select(F.hash("doc_id", "text").alias("tag"), "text")


def test_many_null_ids_and_copies(spark):
    """Thousands of rows without an id, and of copies of one text."""
    rng = random.Random(11)
    body = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(None, f"{i} " + "".join(rng.choice("abcdefgh ") for _ in range(60)), "en", "a", 1) for i in range(2500)]
    rows += [(i, body, "en", "a", 1) for i in range(1500)] + [(None, body, "en", "a", 1)] * 200
    rows += [(5000 + i, body[: 40 + i], "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert found(docs) == collections.Counter(r[:5] for r in brute(rows))


def test_deep_shallow_order():
    rng = random.Random(2)
    for _ in range(60):
        strings, group = [], []
        for g in range(rng.randrange(1, 6)):
            stem = bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 20, 36])))
            for _ in range(rng.randrange(1, 30)):
                strings.append(stem + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(14))))
                group.append(g)
        group = np.array(group)
        order = suffixes.deep_shallow(strings, group)
        assert sorted(order.tolist()) == list(range(len(strings)))
        assert (np.diff(group[order]) >= 0).all()
        for g in set(group.tolist()):
            own = [strings[i] for i in order if group[i] == g]
            short = [s[:8].ljust(8, b"\0") for s in own]
            assert short == sorted(short)
            deep = [s for s in own if len(s) >= 32]
            assert deep == sorted(deep)
        common = suffixes.shared_prefixes(strings, order, group)
        for k in range(1, len(order)):
            one, two = strings[order[k - 1]], strings[order[k]]
            n = 0
            while n < min(len(one), len(two)) and one[n] == two[n]:
                n += 1
            assert common[k] == (n if group[order[k]] == group[order[k - 1]] else -1)


def test_blind_trie():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(40))]
        trie = suffixes.BlindTrie(0)
        for i, s in enumerate(strings):
            trie.add(s, i)
        assert [strings[i] for i in trie.items()] == sorted(strings)


def test_anchors_and_blobs():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 100, 900).astype(np.uint8)
    hashes = suffixes.run_hashes(raw, 20)
    names = {}
    for i, h in enumerate(hashes.tolist()):
        assert names.setdefault(h, raw[i : i + 20].tobytes()) == raw[i : i + 20].tobytes()
    chosen = suffixes.lowest(hashes, 31)
    assert chosen.tolist() == [i + int(hashes[i : i + 31].argmin()) for i in range(len(hashes) - 30)]
    windows = sum(high - low + 1 for _, _, low, high in zip(*suffixes.anchors(raw, np.repeat([0, 1], [400, 500]))))
    assert windows == 351 + 451
    for values in ([5], [1, 2, 1 << 47], [7, 7, 9, (1 << 31) + 9]):
        seeds, tags = np.array(values, np.uint64), np.arange(len(values)).astype(np.uint32)
        back = suffixes._unblob(suffixes._blob(seeds, tags))
        assert back[0].tolist() == values and back[1].tolist() == tags.tolist()


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = collections.Counter(map(tuple, QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()))
    assert got == collections.Counter(r[:5] for r in brute(rows))
    assert any(r[2] for r in got)
