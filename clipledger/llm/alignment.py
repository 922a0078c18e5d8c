"""Tokens of two tokenizers aligned by products of their token-byte incidence matrices."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import per_process, slices
from clipledger.llm.packing import WordEncoder, _safe_parts
from clipledger.session import store

# Bytes of text whose matrices are multiplied at once; longer texts go in blocks of rows.
BLOCK_BYTES = 1 << 20
# What stands in front of a text so that its first word is encoded with its blank, like all others.
LEAD = "a "
# Bits of a pair's code that hold the id of B.
B_BITS = 32


@dataclass
class Csr:
    """Rows of column numbers: row i has ``columns[starts[i]:starts[i + 1]]``; all entries are 1."""

    starts: np.ndarray
    columns: np.ndarray


def tiles(sizes: np.ndarray) -> Csr:
    """Incidence of tokens (rows) and the bytes (columns) they cover, one token after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(starts, np.arange(starts[-1]))


def transposed(matrix: Csr, columns: int) -> Csr:
    rows = np.repeat(np.arange(len(matrix.starts) - 1), np.diff(matrix.starts))
    order = np.argsort(matrix.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(matrix.columns, minlength=columns))])
    return Csr(starts, rows[order])


def gustavson(left: Csr, right: Csr, width: int) -> tuple[Csr, np.ndarray]:
    """The product row by row, with its values: each row adds up the rows of ``right`` it names.

    ``width``: columns of ``right``. Terms that meet in one place are added.
    """
    rows = np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts))
    first, terms = right.starts[left.columns], right.starts[left.columns + 1] - right.starts[left.columns]
    rows = np.repeat(rows, terms)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(terms) - terms, terms)
    cell = rows * width + right.columns[np.repeat(first, terms) + inside]
    if len(cell) and (np.diff(cell) < 0).any():
        cell = np.sort(cell)
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    values = np.diff(np.append(begins, len(cell)))
    counts = np.bincount(cell[begins] // width, minlength=len(left.starts) - 1)
    return Csr(np.concatenate([[0], np.cumsum(counts)]), cell[begins] % width), values


def overlap_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, bytes in common) of all tokens that overlap; ``a``, ``b``: their sizes.

    Both cover the same bytes. The product of A's incidence with B's transposed one has them as its
    entries. Rows of A are multiplied in blocks, so memory follows a block and the longest token.
    """
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    found, row = [], 0
    while row < len(a):
        begin = int(ends_a[row] - a[row])
        after = max(int(np.searchsorted(ends_a, begin + BLOCK_BYTES, "right")), row + 1)
        end = int(ends_a[after - 1])
        low = int(np.searchsorted(ends_b, begin, "right"))
        high = int(np.searchsorted(ends_b, end, "left")) + 1
        # The part of B that lies in the bytes of this block.
        edges = np.clip(np.concatenate([ends_b[low:high] - b[low:high], ends_b[high - 1 : high]]), begin, end)
        incidence = tiles(a[row:after])
        product, values = gustavson(incidence, transposed(tiles(np.diff(edges)), end - begin), high - low)
        rows = np.repeat(np.arange(row, after), np.diff(product.starts))
        found.append((rows, product.columns + low, values))
        row = after
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token: groups end where tokens of both ends meet."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    near = np.minimum(np.searchsorted(ends_b, ends_a), max(len(b) - 1, 0))
    closes_a = ends_b[near] == ends_a if len(b) else np.zeros(len(a), bool)
    closes_b = np.zeros(len(b), bool)
    closes_b[near[closes_a]] = True
    return np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b


def members(group: np.ndarray, count: int) -> Csr:
    """Incidence of tokens (rows) and groups (columns)."""
    return Csr(np.arange(len(group) + 1), group) if count else Csr(np.zeros(1, np.int64), group)


def shared_counts(group_a: np.ndarray, group_b: np.ndarray, count: int) -> np.ndarray:
    """Shared-group links of each A token: entries of its row of the product of the group incidences.

    Only their numbers are needed here, so the product is counted and not written out;
    :func:`shared_links` writes it.
    """
    across = transposed(members(group_b, count), count)
    left = members(group_a, count)
    return np.diff(across.starts)[left.columns]


def shared_links(group_a: np.ndarray, group_b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all tokens in one group, by the product of the group incidences."""
    product, _ = gustavson(members(group_a, count), transposed(members(group_b, count), count), len(group_b))
    return np.repeat(np.arange(len(group_a)), np.diff(product.starts)), product.columns


class Vocabularies:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = WordEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {chr(b if b not in self.a.alphabet else self.a.alphabet[b]): b for b in range(256)}
        names = self.a.tokenizer.get_vocab()
        of_a = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            of_a[number] = bytes(back[c] for c in name if c in back)
        of_b = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            of_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode())
        # Pieces never hold a blank behind another sign, so a text may be cut before a lone blank.
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.sizes_a, self.flat_a, self.at_a = self._table(of_a)
        self.sizes_b, self.flat_b, self.at_b = self._table(of_b)
        # How ids are written in a list of groups: the last of a side is followed by its mark.
        inner = [f"{i}," for i in range(max(len(of_a), len(of_b)))]
        self.shown = [*inner, *(f"{i}|" for i in range(len(inner))), *(f"{i};" for i in range(len(inner)))]
        self.step = len(inner)

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return sizes, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        lead = len(self.a._whole(LEAD[:1])) // 4
        a = [np.frombuffer(raw, "<u4")[lead:].astype(np.int64) for raw in self.a.encode([LEAD + t for t in texts])]
        b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)] if texts else []
        return a, b

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode` for one long text, cut for B where no piece can reach across."""
        parts = _safe_parts(text) if self.cuts else [text]
        # B puts the blank that a part begins with in front by itself.
        b = [self.b.encode(p[1:] if i else p, num_threads=1) for i, p in enumerate(parts)]
        return self.encode_a(text), np.array([x for ids in b for x in ids], np.int64)

    def encode_a(self, text: str) -> np.ndarray:
        lead = len(self.a._whole(LEAD[:1])) // 4
        return np.frombuffer(self.a.encode([LEAD + text])[0], "<u4")[lead:].astype(np.int64)


def _spelled(ids: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of tokens one after the other."""
    own = sizes[ids]
    return flat[np.repeat(at[ids] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]


@dataclass
class Aligned:
    """Documents of a batch: tokens, links and groups, one document after the other."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    overlap: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align_texts(texts: list[str | None], words: Vocabularies) -> Aligned:
    """Tokens, links and groups of texts; those that a tokenizer does not spell exactly have none."""
    asked = [t or "" for t in texts]
    long = [len(t) > BLOCK_BYTES for t in asked]
    a, b = words.encode(["" if many else t for t, many in zip(asked, long)])
    for i in np.flatnonzero(long):
        a[i], b[i] = words.encode_long(asked[i])
    none = np.zeros(0, np.int64)
    for i, text in enumerate(asked):
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        if not text or not all(
            int(sizes[ids].sum()) == len(raw) and np.array_equal(_spelled(ids, flat, at, sizes), raw)
            for ids, flat, at, sizes in (
                (a[i], words.flat_a, words.at_a, words.sizes_a),
                (b[i], words.flat_b, words.at_b, words.sizes_b),
            )
        ):
            a[i] = b[i] = none
    number = np.arange(len(asked))
    doc_a, doc_b = np.repeat(number, [len(x) for x in a]), np.repeat(number, [len(x) for x in b])
    ids_a = np.concatenate([none, *a])
    ids_b = np.concatenate([none, *b])
    # Documents cover the same bytes with A and B, so both may be laid end to end.
    sizes_a, sizes_b = words.sizes_a[ids_a], words.sizes_b[ids_b]
    links = overlap_links(sizes_a, sizes_b)
    return Aligned(ids_a, ids_b, doc_a, doc_b, *links, *groups(sizes_a, sizes_b))


def shown_groups(found: Aligned, words: Vocabularies, docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document; '' without tokens."""
    n_a, n_b = len(found.ids_a), len(found.ids_b)
    if not n_a:
        return [""] * docs
    total = int(found.group_a[-1]) + 1
    in_a = np.bincount(found.group_a, minlength=total)
    in_b = np.bincount(found.group_b, minlength=total)
    spot_a = np.arange(n_a) + (np.cumsum(in_b) - in_b)[found.group_a]
    spot_b = np.arange(n_b) + np.cumsum(in_a)[found.group_b]
    last_a = np.append(found.group_a[1:] != found.group_a[:-1], True)
    last_b = np.append(found.group_b[1:] != found.group_b[:-1], True)
    line = np.zeros(n_a + n_b, np.int64)
    line[spot_a] = found.ids_a + last_a * words.step
    line[spot_b] = found.ids_b + last_b * 2 * words.step
    sizes = np.bincount(found.doc_a, minlength=docs) + np.bincount(found.doc_b, minlength=docs)
    out, begin, name = [], 0, words.shown.__getitem__
    for size in sizes.tolist():
        out.append("".join(map(name, line[begin : begin + size].tolist()))[:-1])
        begin += size
    return out


class _Seen:
    """The pairs a task has met: a number for each, and in how many documents it was linked."""

    def __init__(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.numbers = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of ``codes``, each of which stands once for every document that has it."""
        own, back, docs = np.unique(codes, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.codes, own)
        known = np.zeros(len(own), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == own[inside]
        fresh = len(self.docs) + np.arange(int((~known).sum()))
        numbers = np.empty(len(own), np.int64)
        numbers[known] = self.numbers[place[known]]
        numbers[~known] = fresh
        self.codes = np.insert(self.codes, place[~known], own[~known])
        self.numbers = np.insert(self.numbers, place[~known], fresh)
        self.docs = np.concatenate([self.docs, np.zeros(len(fresh), np.int64)])
        np.add.at(self.docs, numbers, docs)
        return numbers[back]


def _narrow(values: np.ndarray, kinds: tuple[str, ...]) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype(next(k for k in kinds if top < 1 << 8 * np.dtype(k).itemsize)).tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


_FACTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]
_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string"
# A row of a document has its facts, the steps between the numbers of its pairs and how often each
# pair is linked; a row of a pair has its number in the task, its code and its documents there.
_TASK = f"part int, {_DOC}, steps binary, times binary, n_pairs int, number bigint, code bigint, docs bigint"
_KINDS = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 3]
_PAIR_ROWS = 1 << 16


def _aligned_tasks(path_a: str, path_b: str):
    names = [c.split()[0] for c in _TASK.split(", ")]
    schema = pa.schema(list(zip(names, _KINDS)))

    def run(batches):
        words = per_process(f"aligner {path_a} {path_b}", lambda: Vocabularies(path_a, path_b))
        part, seen = TaskContext.get().partitionId(), _Seen()
        for batch in batches:
            for whole in slices(batch, "text"):
                for rows in slices(whole, "text", BLOCK_BYTES):
                    yield pa.RecordBatch.from_pydict(document_rows(rows, words, seen, part), schema=schema)
        order = np.argsort(seen.numbers)
        codes = seen.codes[order]
        for begin in range(0, len(codes), _PAIR_ROWS):
            own = slice(begin, begin + _PAIR_ROWS)
            size = len(codes[own])
            columns = {n: pa.nulls(size, k) for n, k in zip(names, _KINDS)}
            columns |= {
                "part": pa.array(np.full(size, part, np.int32)),
                "number": pa.array(np.arange(begin, begin + size)),
                "code": pa.array(codes[own]),
                "docs": pa.array(seen.docs[own]),
            }
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    def document_rows(rows, words, seen, part):
        texts = rows.column("text").to_pylist()
        docs = len(texts)
        found = align_texts(texts, words)
        code = found.ids_a[found.link_a] << B_BITS | found.ids_b[found.link_b]
        owner = found.doc_a[found.link_a]
        order = np.lexsort((code, owner))
        own, in_doc = code[order], owner[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (in_doc[1:] != in_doc[:-1])
        begins = np.flatnonzero(fresh)
        times = np.diff(np.append(begins, len(own)))
        numbers, pair_doc = seen.add(own[begins]), in_doc[begins]
        order = np.lexsort((numbers, pair_doc))
        numbers, times = numbers[order], times[order]
        edges = np.searchsorted(pair_doc, np.arange(docs + 1))
        steps = np.diff(numbers, prepend=0)
        heads = edges[:-1][edges[:-1] < edges[1:]]
        steps[heads] = numbers[heads]
        count = lambda x: np.bincount(x, minlength=docs)
        last = int(found.group_a[-1]) + 1 if len(found.group_a) else 0
        shared = shared_counts(found.group_a, found.group_b, last)
        heads_a = np.append(True, found.group_a[1:] != found.group_a[:-1])[: len(found.group_a)]
        shown = shown_groups(found, words, docs)
        kinds = ("<u1", "<u2", "<u4", "<u8")
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return {
            "part": pa.array(np.full(docs, part, np.int32)),
            "doc_id": rows.column("doc_id"),
            "n_a": pa.array(count(found.doc_a)),
            "n_b": pa.array(count(found.doc_b)),
            "n_groups": pa.array(count(found.doc_a[heads_a])),
            "n_links": pa.array(count(owner)),
            "n_shared": pa.array(np.bincount(found.doc_a, weights=shared, minlength=docs).astype(np.int64)),
            "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]),
            "steps": pa.array([_narrow(steps[b:e], kinds) for b, e in spans], pa.binary()),
            "times": pa.array([_narrow(times[b:e], kinds) for b, e in spans], pa.binary()),
            "n_pairs": pa.array(np.diff(edges), pa.int32()),
            "number": pa.nulls(docs, pa.int64()),
            "code": pa.nulls(docs, pa.int64()),
            "docs": pa.nulls(docs, pa.int64()),
        }

    return run


def _rated(batches):
    """Documents with their figures. The pairs of a task come before its documents, by number."""
    schema = pa.schema(
        [(n, k) for n, k in zip(_FACTS, _KINDS[1:8])] + [("n_best", pa.int64()), ("count_sum", pa.int64())]
    )
    part, parts, totals, best = None, [], None, None
    for batch in batches:
        of = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for begin, end in zip(cuts, cuts[1:]):
            rows = batch.slice(begin, end - begin)
            if part != of[begin]:
                part, parts, totals = of[begin], [], None
            pairs = rows.num_rows - rows.column("number").null_count
            if pairs:
                parts.append([rows.column(c).slice(0, pairs).to_numpy(zero_copy_only=False) for c in ("total", "best")])
            rows = rows.slice(pairs)
            if not rows.num_rows:
                continue
            if totals is None:
                totals = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
                best = np.concatenate([np.zeros(0, bool), *(p[1] for p in parts)])
            sums, bests = [], []
            for steps, times, n in zip(*(rows.column(c).to_pylist() for c in ("steps", "times", "n_pairs"))):
                numbers, often = np.cumsum(_wide(steps, n)), _wide(times, n)
                sums.append(int(totals[numbers] @ often))
                bests.append(int(often[best[numbers]].sum()))
            columns = [rows.column(c) for c in _FACTS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], schema=schema)


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How the tokens of two tokenizers lie on each other in every document of ``docs``.

    ``path_a``: a byte-level vocabulary, used on a blank and the text; ``path_b``: a piece model that
    puts that blank in front itself. The token-byte incidence matrices A and B are built row by row
    (:class:`Csr`); the entries of A Bt are the links, tokens that share bytes, and those of the product
    of the token-group incidences are the tokens that share a group (:func:`shared_counts`). Groups end
    at bytes where a token of A and one of B end.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_shared (pairs of tokens in one group),
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, the ids of each group), n_best and count_sum. A pair of ids
    counts the documents of the table that hold it linked; n_best are the links whose count is
    the highest of their A id, ties included, and count_sum adds the counts of all links.
    :func:`token_links` gives the links themselves.

    Texts are encoded once, in the task that reads them. It numbers the pairs it meets, so a
    document carries small numbers, and sends each pair once with its documents; counts come back
    to the documents of a task by its number, pair by pair, and no document is looked at by
    its pairs. What a task holds are the pairs of its own input.

    Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros and '' for
    groups_sha256. Null doc_ids and repeated rows count as documents of their own. Long texts are
    encoded in parts that no piece crosses. An empty table gives an empty result; other columns are
    not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tasks = store(rows.mapInArrow(_aligned_tasks(path_a, path_b), _TASK), "aligned")
    pairs = tasks.filter("number is not null").select("part", "number", "code", "docs")
    totals = pairs.groupBy("code").agg(F.sum("docs").alias("total"))
    totals = totals.withColumn("a", F.shiftright("code", B_BITS))
    tops = totals.groupBy("a").agg(F.max("total").alias("top"))
    rated = totals.join(tops, "a").select("code", "total", (F.col("total") == F.col("top")).alias("best"))
    facts = pairs.join(rated, "code").select("part", "number", "total", "best")
    carried = tasks.filter("number is null").select("part", *_FACTS, "steps", "times", "n_pairs")
    mixed = carried.unionByName(facts, allowMissingColumns=True)
    last = tasks.agg(F.coalesce(F.max("part"), F.lit(0)).alias("last")).first().last
    dealt = mixed.repartitionById(last + 1, F.col("part")).sortWithinPartitions(
        "part", F.col("number").asc_nulls_last()
    )
    return dealt.mapInArrow(_rated, f"{_DOC}, n_best bigint, count_sum bigint")


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per link: doc_id, a_place, b_place (numbers of the tokens), a_id, b_id, n_bytes shared, group."""
    names = ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes", "group"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        words = per_process(f"aligner {path_a} {path_b}", lambda: Vocabularies(path_a, path_b))
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                found = align_texts(rows.column("text").to_pylist(), words)
                owner = found.doc_a[found.link_a]
                number = np.arange(rows.num_rows)
                first_a, first_b = np.searchsorted(found.doc_a, number), np.searchsorted(found.doc_b, number)
                group = found.group_a[found.link_a]
                head = found.group_a[np.minimum(first_a, max(len(found.group_a) - 1, 0))][owner] if len(owner) else group
                numbers = [found.link_a - first_a[owner], found.link_b - first_b[owner]]
                numbers += [found.ids_a[found.link_a], found.ids_b[found.link_b], found.overlap, group - head]
                ids = rows.column("doc_id").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(n) for n in numbers)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))
