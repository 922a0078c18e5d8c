"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import per_process, slices
from clipledger.session import store

CAPACITY = 1024
END_ID = 2
# Words whose ids a process keeps at hand, twice, and words encoded in one call.
KNOWN_WORDS = 500_000
CALL_WORDS = 1000

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids binary, _part int, _rank bigint"
PACKED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer splits a text before any single blank between two characters that are no white
    space, wherever the blank stands, so the ids of a text are those of its words with the blank
    in front, one after the other. Words met before are looked up; of those met long ago, the ones
    not met again are forgotten. Texts with other white space next to a blank are encoded whole.
    """

    def __init__(self, path: str) -> None:
        # One task uses one core; the setting is read when the tokenizer first runs.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        # Ids travel in two bytes each where all of them fit.
        self.carried = "<u2" if len(self.opens) <= 1 << 16 else "<u4"
        # The byte-level alphabet writes a blank as this letter.
        self.opens[[i for word, i in vocabulary.items() if word.startswith("Ġ")]] = True
        # The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ".,;:!?"}

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4").tobytes()

    def _call(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a blank in front."""
        found = self.tokenizer.encode_batch_fast(
            [" " + " ".join(words)], add_special_tokens=False
        )[0]
        ids = np.array(found.ids, "<u4")
        cuts = (4 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
        if len(cuts) != len(words) + 1:
            raise ValueError("the tokenizer does not split before blanks")
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn(self, words: set[str]) -> set[str]:
        """Make ``words`` known; returns those with white space at an end, which cannot be."""
        known, older, rough, marked, new, mixed = self.known, self.older.get, set(), [], set(), []
        for word in words:
            ids = older(word)
            if ids is not None:
                known[word] = ids
            elif word.isalpha():
                new.add(word)
            elif word[-1:] in self.marks and word[:-1].isalpha():
                # The tokenizer always splits one mark from the letter before it.
                marked.append(word)
                if word[:-1] not in known:
                    new.add(word[:-1])
            elif not word or word[0].isspace() or word[-1].isspace():
                rough.add(word)
            else:
                mixed.append(word)
        # A blank and letters are one unit to the tokenizer, so its model alone gives their ids.
        split, alphabet = self.tokenizer.model.tokenize, self.alphabet
        for word in new:
            text = word if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
            found = [t.id for t in split("Ġ" + text)]
            known[word] = struct.pack(f"<{len(found)}I", *found)
        for i in range(0, len(mixed), CALL_WORDS):
            call = mixed[i : i + CALL_WORDS]
            known.update(zip(call, self._call(call), strict=True))
        for word in marked:
            known[word] = known[word[:-1]] + self.marks[word[-1]]
        return rough

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, new, parts = self.known, set(), []
        for text in texts:
            words = text.split(" ")
            parts.append(words)
            new.update([w for w in words if w not in known])
        rough, out = self._learn(new), []
        for text, words in zip(texts, parts, strict=True):
            first = words[0]
            if len(words) == 1 or not first or first[-1].isspace() or (rough and not rough.isdisjoint(words)):
                out.append(b"".join(map(self._whole, _safe_parts(text))))
            else:
                words[0] = " "
                known[" "] = self._whole(first)
                out.append(b"".join(map(known.__getitem__, words)))
        known.pop(" ", None)
        return out


_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _safe_parts(text: str, size: int = 1 << 16) -> list[str]:
    """A long text cut before blanks between two characters that are no white space."""
    parts, begin = [], 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        parts.append(text[begin : cut.start()])
        begin = cut.start()
    return [*parts, text[begin:]]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, numbered per task and length: written once to the shared folder.

    A document is its ids and ``end_id``. Only one longer than ``capacity`` is cut: its first
    piece holds the remainder, all others are full. ``ids`` has those of the piece in as
    few bytes as the vocabulary needs (two or four).
    """
    names = ["doc_id", "piece", "start", "length", "ids", "_part", "_rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        encoder = per_process(f"encoder {path}", lambda: WordEncoder(path))
        end = np.array([end_id], "<u4").tobytes()
        carried = encoder.carried if end_id < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = rows.column("doc_id").to_pylist()
                texts = [t or "" for t in rows.column("text").to_pylist()]
                out = [[] for _ in names]
                for doc, raw in zip(ids, encoder.encode(texts), strict=True):
                    raw += end
                    total = len(raw) // 4
                    start, piece = 0, 0
                    while start < total:
                        size = ((total - 1) % capacity + 1) if start == 0 else capacity
                        own = np.frombuffer(raw, "<u4", size, 4 * start).astype(carried).tobytes()
                        for column, value in zip(out, (doc, piece, start, size, own, part, seen[size])):
                            column.append(value)
                        seen[size] += 1
                        start, piece = start + size, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], schema=schema
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return store(rows.mapInArrow(run, PIECE), "pieces", compression="zstd")


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins by minimum bin slack: [([(length, pieces of it in a bin), ...], bins), ...].

    Each bin takes the longest length left; a subset sum over the lengths left, kept as bit sets,
    finds the combination with it that leaves the least slack, the longest lengths first among
    equals. A combination stays the best as long as its lengths last, so it is used that often
    at once: the work follows the number of distinct lengths, not of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    room = (1 << (capacity + 1)) - 1
    bins = []
    while left:
        lengths = sorted(left)
        longest = lengths[-1]
        take = {longest: 1}
        space = capacity - longest
        # reach[i]: the sums that lengths[:i] can give, as bits.
        reach, stock = [1], dict(left)
        stock[longest] -= 1
        usable = [x for x in lengths if x <= space and stock[x]]
        room = (1 << (space + 1)) - 1
        for length in usable:
            sums, copies, step = reach[-1], min(stock[length], space // length), 1
            while copies:
                step = min(step, copies)
                sums |= (sums << (length * step)) & room
                copies -= step
                step *= 2
            reach.append(sums)
        target = reach[-1].bit_length() - 1
        for i in range(len(usable) - 1, -1, -1):
            length = usable[i]
            for k in range(min(stock[length], target // length), -1, -1):
                if reach[i] >> (target - k * length) & 1:
                    if k:
                        take[length] = take.get(length, 0) + k
                        target -= k * length
                    break
        times = min(left[length] // k for length, k in take.items())
        bins.append((sorted(take.items(), reverse=True), times))
        for length, k in take.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return bins


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` ids.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset and ``ids``, its
    ids as unsigned numbers of four bytes, the lowest first. The pieces of a sequence lie together
    in the order of their offsets, so their ids one after the other are the sequence
    (:func:`sequences`); ids_crc32 is taken from them there. ``path`` is the vocabulary of a
    byte-level tokenizer. Only the histogram of piece lengths, of at most
    ``capacity`` rows, comes to the driver; the bins found there are broadcast (their number
    follows the lengths, not the rows) and each piece finds its bin by its rank among the pieces
    of its length. Ranks come from totals per task, so no length, however frequent, meets in one
    task.

    Null and empty texts are one piece of one id. Repeated rows and null doc_ids are packed like
    others. Long texts are encoded whole and cut after that. An empty table gives an empty result;
    other columns are not looked at.
    """
    pieces = tokenized_pieces(docs, path, capacity, end_id)
    totals = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    bins = minimum_slack(histogram, capacity)

    # For each length: from which rank on its pieces lie in which bins.
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, times in bins:
        offset = 0
        for length, k in content:
            spans.setdefault(length, []).append((used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    plan = {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in spans.items()}
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    before = Window.partitionBy("length").orderBy("_part")
    carried = totals.select("_part", "length", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    # A task's share of the few bases is a small table; the pieces need no sort to meet it.
    ranked = pieces.join(carried.hint("shuffle_hash"), ["_part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("_base") + F.col("_rank")).alias("_at")
    )
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def place(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_at").to_numpy()
            sequences, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, base, k, offset = shared.value[int(length)]
                at = np.searchsorted(first, ranks[rows], "right") - 1
                inside = ranks[rows] - first[at]
                sequences[rows] = base[at] + inside // k[at]
                offsets[rows] = offset[at] + inside % k[at] * length
            columns = [batch.column(n) for n in schema.names[:5]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences), pa.array(offsets)], schema=schema
            )

    placed = ranked.mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids binary, "
        "sequence_id bigint, offset bigint",
    )
    together = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return together.mapInArrow(_with_ids, PACKED)


def _with_ids(batches):
    """The packed pieces with their ids in four bytes each, and the checksum of these."""
    for batch in batches:
        for rows in slices(batch, "ids"):
            carried = rows.column("ids")
            places = np.frombuffer(carried.buffers()[1], np.int32)[carried.offset : carried.offset + len(carried) + 1]
            ids = int(pa.compute.sum(rows.column("length")).as_py())
            raw = np.frombuffer(carried.buffers()[2], np.uint8)[places[0] : places[-1]]
            width = len(raw) // ids
            # All ids of the slice at once; each piece is a stretch of them.
            wide = raw.view(f"<u{width}").astype("<u4")
            edges = ((places - places[0]) // width * 4).astype(np.int32)
            whole = memoryview(wide).cast("B")
            cuts = edges.tolist()
            sums = [zlib.crc32(whole[b:e]) for b, e in zip(cuts, cuts[1:])]
            column = pa.BinaryArray.from_buffers(
                pa.binary(), len(carried), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(wide)]
            )
            out = {n: rows.column(n) for n in ("doc_id", "piece", "start", "length")}
            out["ids_crc32"] = pa.array(sums, pa.int64())
            out |= {n: rows.column(n) for n in ("sequence_id", "offset")}
            yield pa.RecordBatch.from_pydict(out | {"ids": column})


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of the result of :func:`pack`: one row per sequence, ids as there."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    # Binary values are joined by concat only; a sequence has ``capacity`` pieces at most.
    joined = F.aggregate(members, F.lit(b""), lambda ids, m: F.concat(ids, m["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
