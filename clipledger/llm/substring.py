"""Substring dedup by seed and extend over winnowed anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import SLICE_BYTES, slices, with_row_key
from clipledger.session import store

WINDOW = 13
ANCHOR = 4
# Anchors a window chooses from, and words that its windows can reach on either side of an anchor.
CHOICES = WINDOW - ANCHOR + 1
REACH = WINDOW - ANCHOR
# Cells in which anchors are counted to find those too frequent for one task, and how many
# times the mean a cell may hold. Both change the way of rows, not the result.
CELLS = 1 << 16
CELL_TIMES, CELL_LEAST = 8, 1000
# Bytes of hash sent for each window of an anchor, besides the 8 of the anchor itself.
SIGN = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit numbers (splitmix64, its public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _position_weights(count: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of a UTF-8 text, all words at once."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _tables(self, size: int) -> None:
        if len(self.up) < size:
            count = max(size, 1 << 16)
            self.up = _powers(int(_BASE), count)
            self.down = _powers(pow(int(_BASE), -1, 1 << 64), count)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """Hashes in word order. ``raw``: bytes of one text, or of several with blanks between."""
        parts, begin = [], 0
        while begin < len(raw):
            end = min(begin + SLICE_BYTES, len(raw))
            if end < len(raw):
                blanks = np.flatnonzero(_BLANK[raw[begin:end]])
                if len(blanks):
                    end = begin + int(blanks[-1]) + 1
                else:  # one word longer than a slice
                    rest = np.flatnonzero(_BLANK[raw[end:]])
                    end = end + int(rest[0]) + 1 if len(rest) else len(raw)
            parts.append(self._block(raw[begin:end]))
            begin = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _block(self, raw: np.ndarray) -> np.ndarray:
        self._tables(len(raw) + 1)
        letter = np.concatenate([[False], ~_BLANK[raw], [False]])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        begins, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        plain = (sums[ends] - sums[begins]) * self.down[begins]
        return _mix(plain + (ends - begins).astype(np.uint64) * _BASE)


def run_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    count = len(words) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    weights = _position_weights(size, seed)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total += words[i : i + count] * weights[i]
    return _mix(total)


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors: hash, place, and the windows that chose it as words left of it (low, high).

    ``words``: hashes of the words of several documents in a row, ``first[i]``: place where the
    document of word i begins. Each window of WINDOW words chooses its smallest anchor, the
    leftmost of equals, so equal windows choose alike; windows across documents are left out.
    """
    runs = run_hashes(words, ANCHOR, 1)
    count = len(words) - WINDOW + 1
    if count < 1:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    best, choice = runs[:count].copy(), np.zeros(count, np.int64)
    for i in range(1, CHOICES):
        other = runs[i : i + count]
        lower = other < best
        best[lower] = other[lower]
        choice[lower] = i
    starts = np.flatnonzero(first[:count] == first[WINDOW - 1 :])
    if not len(starts):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    places = starts + choice[starts]
    cut = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last = np.append(cut[1:], len(places)) - 1
    place = places[cut]
    return runs[place], place, place - starts[last], place - starts[cut]


# A row on its way to the others with its anchor: hash, document, the extensions (SIGN bytes for each
# window that chose the anchor, from the most words on its left to the fewest), and packed place
# (32 bits), low and high (4 bits each), tag of the text (20 bits), mark of rows already decided.
_ROW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pack", pa.int64()), ("signs", pa.binary())])
_ROW_COLUMNS = "`key` bigint, doc bigint, pack bigint, signs binary"
_TAG = (1 << 20) - 1


def _pack(place, low, high, tag, decided):
    return place | low << 32 | high << 36 | tag << 40 | np.int64(decided) << 60


def _batch_words(batch: pa.RecordBatch, hasher: WordHasher):
    """Word hashes of all texts of a batch, and for each word the number of its row."""
    raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
    words = [hasher(np.frombuffer(t, np.uint8)) for t in raw] if any(len(t) > SLICE_BYTES for t in raw) else None
    if words is None:
        whole = np.frombuffer(b"\n".join(raw), np.uint8)
        words_all = hasher(whole)
        sizes = np.fromiter((len(t.split()) for t in raw), np.int64, len(raw))
        return words_all, sizes
    return np.concatenate(words), np.fromiter(map(len, words), np.int64, len(words))


def _groups(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Which places of ``order`` begin a new combination of ``columns``."""
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        c = c[order]
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _first_of_group(fresh: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def _batch_anchors(batch: pa.RecordBatch, hasher: WordHasher):
    """Anchors of a batch, one per content and document.

    Returns the hash, place in the document, low, high, a hash of all windows, the number of the
    first window, the row, and the hashes of all windows of the batch.
    """
    words, sizes = _batch_words(batch, hasher)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, place, low, high = anchors(words, begin)
    windows = run_hashes(words, WINDOW, 2)
    sums = np.zeros(len(windows) + 1, np.uint64)
    np.cumsum(_mix(windows), out=sums[1:])
    first = place - high
    whole = sums[place - low + 1] - sums[first]
    rows, inside = row[place], place - begin[place]
    # A content that a document repeats is sent once, from its first place.
    order = np.lexsort((inside, high, low, whole, key, rows))
    keep = order[_groups([rows, key, whole, low, high], order)]
    return key[keep], inside[keep], low[keep], high[keep], whole[keep], first[keep], rows[keep], windows


def _count_cells():
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        hasher, counts = WordHasher(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                key = _batch_anchors(part, hasher)[0]
                counts += np.bincount((key % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells])], schema=schema)

    return run


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n of ``count``, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _signs(windows: np.ndarray, first: np.ndarray, count: np.ndarray, decided: np.ndarray, key: np.ndarray) -> pa.Array:
    """For each row the highest SIGN bytes of ``count`` windows from ``first`` on; the key of a decided one."""
    at = np.repeat(first, count) + _spread(count)
    sizes = np.where(decided, 8, count * SIGN)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    raw = np.zeros(int(offsets[-1]), np.uint8)
    raw[np.repeat(~decided, sizes)] = windows[at].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIGN].reshape(-1)
    raw[np.repeat(decided, sizes)] = key[decided].astype("<u8").view(np.uint8)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]
    )


def _send(hot: np.ndarray):
    """Rows of anchors. Those in ``hot`` cells are sent window by window."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                key, place, low, high, whole, first, row, windows = _batch_anchors(part, hasher)
                docs = part.column("doc").to_numpy()[row]
                tags = part.column("_k2").to_numpy()[row] & _TAG
                many = hot[(key % np.uint64(CELLS)).astype(np.int64)]
                count = np.where(many, high - low + 1, 1)
                at = np.repeat(np.arange(len(key)), count)
                alone, step = many[at], _spread(count)
                key, place, docs, tags = key[at], place[at], docs[at], tags[at]
                first = first[at] + step
                high = np.where(alone, high[at] - step, high[at])
                low = np.where(alone, high, low[at])
                if len(at):
                    whole = np.where(alone, windows[first], whole[at])
                    key = np.where(alone, _mix(windows[first] + high.astype(np.uint64)), key)
                # Of equal contents in this batch, all but those of the smallest document are
                # decided here; only the smallest goes on.
                order = np.lexsort((docs, high, low, whole, key))
                smallest = docs[order][_first_of_group(_groups([key, whole, low, high], order))]
                decided = np.zeros(len(order), bool)
                decided[order] = docs[order] > smallest
                # A decided row needs no partner: it goes anywhere, spread by its document.
                scattered = _mix(docs.astype(np.uint64) * _BASE + tags.astype(np.uint64))
                signs = _signs(windows, first, np.where(decided, 0, high - low + 1), decided, key)
                key = np.where(decided, scattered, key).view(np.int64)
                pack = _pack(place, low, high, tags, 0) | np.where(decided, np.int64(1) << 60, 0)
                for begin in range(0, len(order), 1 << 16):
                    piece = slice(begin, begin + (1 << 16))
                    columns = [pa.array(c[piece]) for c in (key, docs, pack)]
                    yield pa.RecordBatch.from_arrays([*columns, signs[piece]], schema=_ROW)

    return run


_HIT = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("hit", pa.int64()), ("key", pa.int64())])


def _extend(batches):
    """Windows whose content a smaller document has: (doc, tag, place << 16 | bits by words left).

    Rows come sorted by anchor and document, so the first row of a content has its smallest
    document. Of an anchor cut by a batch only the contents met so far are held, not its rows.
    """
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, pack = (batch.column(i).to_numpy() for i in range(3))
        decided = (pack >> 60 & 1).astype(bool)
        place, low, high = pack & 0xFFFFFFFF, pack >> 32 & 15, pack >> 36 & 15
        span = np.left_shift(1, high + 1) - np.left_shift(1, low)
        bits = np.where(decided, span, 0).astype(np.int64)
        pair = key == key[-1]
        same = key[1:] == key[:-1]
        pair[1:] |= same
        pair[:-1] |= same
        if len(held[0]):
            pair |= key == held[0][0]
        rows = np.flatnonzero(pair & ~decided)
        offsets, raw = _binary(batch.column(3).take(pa.array(rows)))
        count = high[rows] - low[rows] + 1
        at = np.repeat(rows, count)
        words_left = high[at] - _spread(count)
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, :SIGN] = raw[offsets[0] : offsets[-1]].reshape(-1, SIGN)
        sign = wide.view(">u8").reshape(-1).astype(np.uint64)
        columns = [np.concatenate(c) for c in zip(held, (key[at], words_left, sign, doc[at]), strict=True)]
        at = np.concatenate([np.full(len(held[0]), -1), at])
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        fresh = _groups(columns[:3], order)
        smallest = columns[3][order][_first_of_group(fresh)]
        gone = order[(columns[3][order] > smallest) & (at[order] >= 0)]
        np.bitwise_or.at(bits, at[gone], np.left_shift(1, columns[1][gone]))
        first = order[fresh]
        first = first[columns[0][first] == key[-1]]
        held = [c[first] for c in columns]
        hit = np.flatnonzero(bits)
        own = key[hit]
        # A decided row goes by a scattered key and carries that of its anchor.
        sent = np.flatnonzero(decided[hit])
        offsets, raw = _binary(batch.column(3).take(pa.array(hit[sent])))
        whole = np.diff(offsets) == 8
        at = offsets[:-1][whole][:, None] + np.arange(8)
        own[sent[whole]] = raw[at].view("<i8").reshape(-1)
        columns = [doc[hit], pack[hit] >> 40 & _TAG, place[hit] << 16 | bits[hit], own]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_HIT)


def _binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    if not len(array):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def covered(words: np.ndarray, hits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which words lie in a removed window; ``hits`` names one place of each removed content.

    Rows that share a doc_id and a tag get each other's hits: those whose key is not that of
    the anchor, or of the window sent alone, at their place here are of another text.
    """
    out = np.zeros(len(words), bool)
    place, bits = hits >> 16, hits & 0xFFFF
    runs, windows = run_hashes(words, ANCHOR, 1), run_hashes(words, WINDOW, 2)
    keys = keys.view(np.uint64)
    own = place < len(runs)
    if not own.any():
        return out
    place, bits, keys = place[own], bits[own], keys[own]
    low = np.log2(bits & -bits).astype(np.int64)
    first = place - low
    alone = (bits == bits & -bits) & (first >= 0) & (first < len(windows))
    one = _mix(windows[np.where(alone, first, 0)] + low.astype(np.uint64)) if len(windows) else keys + np.uint64(1)
    own = (runs[place] == keys) | (alone & (one == keys))
    place, bits = place[own], bits[own]
    starts = np.concatenate([(place - i)[(bits >> i & 1).astype(bool)] for i in range(REACH + 1)])
    starts = starts[(starts >= 0) & (starts < len(windows))]
    starts = np.flatnonzero(np.isin(windows, windows[starts]))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def _remove(with_text: bool):
    names = ["n_words", "n_removed", "kept_sha256", "text"][: 4 if with_text else 3]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                hits = part.column("hits")
                out = []
                for i, t in enumerate(part.column("text").cast(pa.binary())):
                    raw = t.as_py()
                    words, gone = (raw or b"").split(), 0
                    found = hits[i].as_py() or []
                    if found:
                        numbers = (np.array([h[n] for h in found], np.int64) for n in ("hit", "key"))
                        drop = covered(hasher(np.frombuffer(raw or b"", np.uint8)), *numbers)
                        gone = int(drop.sum())
                        words, total = [w for w, d in zip(words, drop.tolist()) if not d], len(words)
                    else:
                        total = len(words)
                    kept = b" ".join(words)
                    row = (total, gone, hashlib.sha256(kept).hexdigest())
                    # Texts that lose nothing keep their white space.
                    out.append((*row, (kept if gone else raw)) if with_text else row)
                columns = list(zip(*out))
                others = [c for n, c in zip(part.schema.names, part.columns) if n not in ("text", "hits")]
                other_names = [n for n in part.schema.names if n not in ("text", "hits")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                new = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if with_text:
                    new[3] = new[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*others, *new], names=[*other_names, *names])

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, tag, hit, key) for every content to remove from a document; ``docs``: doc, _k2, text."""
    cells = docs.select("text").mapInArrow(_count_cells(), "cell int, n bigint")
    sums = store(cells.groupBy("cell").agg(F.sum("n").alias("n")), "anchor-cells")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    limit = CELL_LEAST + CELL_TIMES * total // CELLS
    hot = np.zeros(CELLS, bool)
    # CELLS rows at most; every cell over the limit has more than its share, so they are few.
    hot[[r.cell for r in sums.filter(F.col("n") > limit).select("cell").collect()]] = True
    rows = docs.mapInArrow(_send(hot), _ROW_COLUMNS)
    return (
        rows.repartition("key")
        .sortWithinPartitions("key", "doc")
        .mapInArrow(_extend, "doc bigint, tag bigint, hit bigint, `key` bigint")
    )


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Words removed that lie in a window of WINDOW words which a smaller doc_id has too.

    Every window is seeded by its winnowed anchor of ANCHOR words, so two documents that share
    the window meet at that anchor. There the match is extended to both sides, window by window, and
    what reaches WINDOW words is removed from all but the smallest document; overlapping windows
    make up the maximal repeats. All windows are judged on the input.

    Copies in one batch are decided there and only the smallest goes on, so a large group sends
    one row per batch; where they meet they are read in order of document, and only the contents
    seen are held. Anchors are counted first, in cells; those in cells that hold too much are
    sent window by window, each to the task of its own content. A hash of 64 bits for the anchor
    and one of 40 bits for the window stand for a window.

    Returns doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the columns of
    ``docs`` with the text kept. A null or empty text has no words and the hash of an empty text. A
    null doc_id is larger than all others. Rows that share a doc_id remove nothing from each
    other; exact repeats lose the same words. An empty table gives an empty result; columns of
    ``docs`` named like the added ones are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256"]
    keyed = with_row_key(docs.drop(*added)).withColumn(
        "_doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    )
    found = repeated_windows(keyed.select(F.col("_doc").alias("doc"), "_k2", "text"))
    hits = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("hit", "key")).alias("hits"))
    kept = [c for c in docs.columns if c not in [*added, "text"]] if with_text else ["doc_id"]
    left = keyed.select(*kept, "text", "_doc", F.col("_k2").bitwiseAND(F.lit(_TAG).cast("bigint")).alias("_tag"))
    joined = left.join(hits, (F.col("_doc") == F.col("doc")) & (F.col("_tag") == F.col("tag")), "left")
    joined = joined.select(*kept, "text", "hits")
    types = dict(joined.dtypes)
    columns = [f"`{c}` {types[c]}" for c in kept]
    columns += ["n_words bigint", "n_removed bigint", "kept_sha256 string"] + ["text string"] * with_text
    return joined.mapInArrow(_remove(with_text), ", ".join(columns))
