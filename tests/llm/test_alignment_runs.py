"""Word runs and token alignment against plain loops, and on odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.llm import alignment, wordruns
from clipledger.llm.queries import PIECES, QUERIES, VOCABULARY
from tests.llm.test_operators import DOCS, clashing, odd_rows


# --- 12 word runs --------------------------------------------------------------------------------


def brute_lyndon(letters):
    out = []
    for i in range(len(letters)):
        j = i + 1
        while j < len(letters) and letters[j:] > letters[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, most=70):
    n, k = rng.randrange(most), rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, n // 2 + 1)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(1500):
        words = some_words(rng)
        assert wordruns.lyndon_lengths(words) == brute_lyndon(words)


@pytest.mark.parametrize("least", [2, 12])
def test_batch_runs(least):
    rng = random.Random(least)
    for _ in range(250):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        codes = np.array([w for d in docs for w in d], np.int64)
        parts = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        begin = np.cumsum([0, *map(len, docs)])
        want = [(s + begin[i], n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d, least)]
        assert [tuple(map(int, r)) for r in wordruns.batch_runs(codes, parts, least)] == want


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_rows():
    rng = random.Random(3)
    rows = odd_rows()
    for i in range(60):
        rows.append((100 + i, " \n".join(f"w{w}" for w in some_words(rng, 200)), "en", "a", 1))
    return rows


def test_word_runs_rows(spark):
    rows = word_rows()
    found = wordruns.word_runs(clashing(spark.createDataFrame(rows, DOCS))).collect()
    got = collections.Counter(
        (r.doc_id, r.text, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found
    )
    want = collections.Counter()
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        # A loop over all periods of the longest text would take too long; it has no repeats.
        runs = brute_runs(words, 12) if len(words) < 1000 else []
        want[doc, text, len(words), tuple(runs), brute_collapsed(words, runs)] += 1
    assert got == want
    assert wordruns.word_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_word_runs_long(spark):
    """One text whose words all repeat, with a long period."""
    rng = random.Random(4)
    unit = [f"u{rng.randrange(40)}" for _ in range(9000)]
    row = wordruns.word_runs(spark.createDataFrame([(1, " ".join(unit * 3 + ["end"]), None, None, None)], DOCS)).first()
    long = [tuple(r) for r in row.runs if r.period >= 9000]
    assert long == [(0, 27000, 9000)] and row.collapsed.endswith(" end") and len(row.collapsed.split()) <= 9001


def test_word_runs_query(spark, tmp_path):
    rows = [r for r in word_rows() if r[1] is None or len(r[1]) < 20_000]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(QUERIES["op12_word_runs"](spark, str(tmp_path)).collect())
    want = collections.Counter()
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        shown = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[
            doc,
            len(runs),
            *best,
            1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(shown.encode()).hexdigest(),
            hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest(),
        ] += 1
    assert collections.Counter({tuple(k): v for k, v in got.items()}) == want
    assert any(k[1] for k in want)


# --- 13 token alignment ----------------------------------------------------------------------------


def test_gustavson():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.random((7, 9)) < 0.3, rng.random((9, 5)) < 0.4
        left, right = (
            alignment.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1]) for m in (a, b)
        )
        product, values = alignment.gustavson(left, right, 5)
        dense = np.zeros((7, 5), int)
        dense[np.repeat(np.arange(7), np.diff(product.starts)), product.columns] = values
        assert (dense == a.astype(int) @ b.astype(int)).all()
        turned = alignment.transposed(left, 9)
        dense = np.zeros((9, 7), bool)
        dense[np.repeat(np.arange(9), np.diff(turned.starts)), turned.columns] = True
        assert (dense == a.T).all()


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(VOCABULARY)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_alignment(texts):
    """Per text: (n_a, n_b, groups, links as (a, b, a_place, b_place)), by loops over bytes."""
    one, two = tokenizers()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    out = []
    for text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        spelled_a = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
        spelled_b = [
            bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            out.append((0, 0, "", []))
            continue
        owner_a = [i for i, t in enumerate(spelled_a) for _ in t]
        owner_b = [i for i, t in enumerate(spelled_b) for _ in t]
        links = sorted(set(zip(owner_a, owner_b)))
        shown, own_a, own_b = [], [], []
        for i in range(len(raw)):
            last = i + 1 == len(raw)
            end_a, end_b = last or owner_a[i + 1] != owner_a[i], last or owner_b[i + 1] != owner_b[i]
            own_a += [a[owner_a[i]]] * end_a
            own_b += [b[owner_b[i]]] * end_b
            if end_a and end_b:
                shown.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        out.append((len(a), len(b), ";".join(shown), [(a[x], b[y], x, y) for x, y in links]))
    return out


def token_rows():
    rng = random.Random(6)
    parts = ["the ", "Übung", "漢字", "🙂", "\n\n", "  ", "\t", "x", "ing ", "<s>", "<|endoftext|>", "1234", "é", " ", "don't "]
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 20_000]
    rows += [(200 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(60))), "en", "a", 1) for i in range(40)]
    rows += [(300, "a▁b c", "en", "a", 1), (301, " leading", "en", "a", 1), (302, "a", "en", "a", 1)]
    return rows


def test_align_tokens(spark, monkeypatch):
    rows = token_rows()
    found = brute_alignment([r[1] for r in rows])
    held = collections.Counter(pair for *_, links in found for pair in {(a, b) for a, b, *_ in links})
    top = collections.defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    want = collections.Counter()
    for row, (n_a, n_b, shown, links) in zip(rows, found):
        sizes = [(g.split("|")[0].count(",") + 1, g.split("|")[1].count(",") + 1) for g in shown.split(";")] if shown else []
        want[
            row[0],
            n_a,
            n_b,
            len(sizes),
            len(links),
            sum(x * y for x, y in sizes),
            hashlib.sha256(shown.encode()).hexdigest() if shown else "",
            sum(held[a, b] == top[a] for a, b, *_ in links),
            sum(held[a, b] for a, b, *_ in links),
        ] += 1
    docs = clashing(spark.createDataFrame(rows, DOCS)).repartition(5, "text")
    got = alignment.align_tokens(docs, VOCABULARY, PIECES).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert any(w[1] == 0 and w[0] == 300 for w in want)
    empty = alignment.align_tokens(spark.createDataFrame([], DOCS), VOCABULARY, PIECES)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum"]


def test_token_links(spark):
    rows = [(i, r[1], None, None, None) for i, r in enumerate(token_rows())]
    found = alignment.token_links(spark.createDataFrame(rows, DOCS), VOCABULARY, PIECES).collect()
    want = {(i, x, y, a, b) for i, (*_, links) in enumerate(brute_alignment([r[1] for r in rows])) for a, b, x, y in links}
    assert {(r.doc_id, r.a_place, r.b_place, r.a_id, r.b_id) for r in found} == want
    assert len(found) == len(want)
    bytes_of = collections.Counter()
    for r in found:
        bytes_of[r.doc_id] += r.n_bytes
    assert all(n == len((" " + rows[i][1]).encode()) for i, n in bytes_of.items())
    assert min(r.group for r in found) == 0


def test_blocks_do_not_change_links():
    """Blocks of rows, cut in the middle of tokens of the other side, and texts cut into parts."""
    words = alignment.Vocabularies(VOCABULARY, PIECES)
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 12))) for _ in range(3000))
    whole = alignment.align_texts([text, None, "b" + text], words)
    before = alignment.BLOCK_BYTES
    try:
        alignment.BLOCK_BYTES = 97
        short = alignment.align_texts([text, None, "b" + text], words)
    finally:
        alignment.BLOCK_BYTES = before
    for name in ("ids_a", "ids_b", "link_a", "link_b", "overlap", "group_a", "group_b"):
        assert np.array_equal(getattr(whole, name), getattr(short, name)), name


def test_shared_links():
    rng = random.Random(9)
    for _ in range(50):
        total = rng.randrange(1, 40)
        a, b = (np.diff(np.array([0, *sorted(rng.sample(range(1, total), rng.randrange(total))), total])) for _ in range(2))
        in_a, in_b = alignment.groups(a, b)
        count = int(in_a[-1]) + 1
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if in_a[i] == in_b[j]]
        assert list(zip(*(x.tolist() for x in alignment.shared_links(in_a, in_b, count)))) == want
        assert alignment.shared_counts(in_a, in_b, count).sum() == len(want)


def test_queries_on_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op12_word_runs", "op13_token_alignment"):
        assert QUERIES[name](spark, sf_dir).select(F.count("doc_id")).first()[0] == docs
