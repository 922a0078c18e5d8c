"""Byte-string dedup over a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import per_process, slices, whole_groups, with_row_key
from clipledger.session import reading_tasks, store

WINDOW = 50
# Bytes of a seed, and seeds that a window chooses its anchor from.
SEED = 20
CHOICES = WINDOW - SEED + 1
# Windows of text handled at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
# Anchors a task gathers before it sends them.
GATHERED = 1 << 21
# Cells of anchors per shuffle partition: they cut the work, not the result.
CELLS_PER_TASK = 8
# A seed in more documents than HOT_LEAST, what one task can hold with ease, and than its share of all
# is sent window by window. At most HOT_SHARE are.
HOT_LEAST, HOT_SHARE = 100_000, 1 << 16
# Texts around anchors that a task remembers to tell copies of them.
KNOWN_TEXTS = 1 << 18
# Bytes up to which suffixes are sorted by multikey quicksort, 8 at a time; blind tries do the rest.
SHALLOW = 32
# Bytes on either side of an anchor, filled up to whole words of 8.
WIDE = 56

_BASE = 0x9E3779B97F4A7C15
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


def _tables() -> tuple[np.ndarray, np.ndarray]:
    size = 2 * BLOCK
    return _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)


def run_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes in a row; equal bytes, equal hashes."""
    count = len(raw) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    if len(raw) < 2 * BLOCK:
        up, down = per_process(f"byte powers {BLOCK}", _tables)
    else:
        up, down = _powers(_BASE, len(raw) + 1), _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * down[:count])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` values in a row, the leftmost of equals."""
    best, place, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, best[step:], best[:-step])
        reach += step
    return place


def anchors(raw: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, low, high) of the anchors of pieces of text that lie one after the other.

    ``piece[i]``: number of the piece of byte i. Each window of WINDOW bytes inside a piece chooses the
    seed in it with the smallest hash, so equal windows choose alike; low to high bytes before the
    place begin the windows that chose it.
    """
    hashes = run_hashes(raw, SEED)
    count = len(raw) - WINDOW + 1
    if count < 1:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    chosen = lowest(hashes, CHOICES)
    starts = np.flatnonzero(piece[:count] == piece[WINDOW - 1 :])
    places = chosen[starts]
    if not len(places):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last = np.append(cut[1:], len(places)) - 1
    place = places[cut]
    return hashes[place], place, place - starts[last], place - starts[cut]


def blocks(texts: list[bytes]):
    """Texts cut into pieces of at most BLOCK windows and laid end to end, about BLOCK bytes at a time.

    Yields the bytes, the piece of each byte, and of each piece its text, its place there and its
    begin in the bytes. Pieces of one text overlap so that each window lies in one piece.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - WINDOW + 1, BLOCK):
            part = text[at : at + BLOCK + WINDOW - 1]
            if held and size + len(part) > BLOCK:
                yield _joined(held)
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.fromiter((len(p) for _, _, p in held), np.int64, len(held))
    rows, places = (np.fromiter((h[i] for h in held), np.int64, len(held)) for i in (0, 1))
    raw = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    return raw, np.repeat(np.arange(len(held)), sizes), rows, places, np.cumsum(sizes) - sizes


# --- which seeds occur in two documents ---------------------------------------------------------------


def _blob(hashes: np.ndarray, tags: np.ndarray) -> bytes:
    """Sorted numbers as steps of four bytes where that is enough, and their tags."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    short = len(steps) > 1 and int(steps[1:].max()) < 1 << 32
    head = hashes[:1].tobytes() + steps[1:].astype("<u4").tobytes() if short else hashes.tobytes()
    return bytes([short]) + head + tags.astype("<u4").tobytes()


def _unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if raw[0]:
        count = (len(raw) - 5) // 8
        steps = np.frombuffer(raw, "<u4", count - 1, 9).astype(np.uint64)
        hashes = np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), steps]))
    else:
        count = (len(raw) - 1) // 12
        hashes = np.frombuffer(raw, "<u8", count, 1)
    return hashes, np.frombuffer(raw, "<u4", count, len(raw) - 4 * count)


_CELL = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
# Kinds of rows: seeds met in one document of a task, seeds met in several with how many these
# were (both in the cell of the seed), and the documents of the latter, which are known to share.
_ONE, _MANY, _KNOWN = 0, 1, 2


def _gather(cells: int):
    """The distinct seeds of each document, packed by cell. ``tag`` stands for a document."""

    def send(hashes: list, tags: list):
        seed, tag = np.concatenate(hashes), np.concatenate(tags)
        order = np.lexsort((tag, seed))
        seed, tag = seed[order], tag[order]
        fresh = np.append(True, seed[1:] != seed[:-1])
        begins = np.flatnonzero(fresh)
        times = np.diff(np.append(begins, len(seed)))
        alone = times == 1
        yield from packed(seed[begins[alone]], tag[begins[alone]], _ONE)
        yield from packed(seed[begins[~alone]], times[~alone], _MANY)
        yield from packed(seed[~np.repeat(alone, times)], tag[~np.repeat(alone, times)], _KNOWN)

    def packed(seed, tag, kind):
        if not len(seed):
            return
        # Cells are ranges of the seed, so what is sorted by seed is sorted by cell.
        cell = (seed // np.uint64(-(-(1 << 48) // cells))).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        rows = [_blob(seed[b:e], tag[b:e]) for b, e in zip(cuts[:-1], cuts[1:])]
        # What is known needs no partner: it goes to any task.
        where = cell[cuts[:-1]] if kind != _KNOWN else -1 - cell[cuts[:-1]]
        columns = [pa.array(where, pa.int32()), pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_CELL)

    def run(batches):
        hashes, tags, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_py() or b"" for t in part.column("text").cast(pa.binary())]
                tag = part.column("tag").to_numpy().view(np.uint32)
                for raw, piece, rows, _, _ in blocks(texts):
                    found, place, _, _ = anchors(raw, piece)
                    # 48 bits of the hash and the row within the block: one entry per document and seed.
                    order = np.lexsort((rows[piece[place]], found))
                    seed, row = (found >> np.uint64(16))[order], rows[piece[place]][order]
                    fresh = np.append(True, (seed[1:] != seed[:-1]) | (row[1:] != row[:-1]))[: len(seed)]
                    hashes.append(seed[fresh])
                    tags.append(tag[row[fresh]])
                    held += len(hashes[-1])
                    if held > GATHERED:
                        yield from send(hashes, tags)
                        hashes, tags, held = [], [], 0
        if held:
            yield from send(hashes, tags)

    return run


_SHARED = pa.schema([("tag", pa.int32()), ("seed", pa.int32()), ("docs", pa.int64())])


def _meet(batches):
    """(tag, seed, documents) of the seeds that two documents have; of the seed the lowest 32 bits.

    A seed stands there for the documents of one task once, so what a cell holds follows the number of
    tasks, not of copies.
    """
    for group in whole_groups(batches, ["cell"]):
        kind = group.column("kind").to_numpy()
        found = [_unblob(b.as_py()) for b in group.column("blob")]
        out = []
        known = [f for f, k in zip(found, kind) if k == _KNOWN]
        if known:
            seed, tag = (np.concatenate(c) for c in zip(*known))
            out.append((tag, seed, np.zeros(len(seed), np.int64), np.zeros(len(seed), bool)))
        rest = [(s, t, np.full(len(s), k)) for (s, t), k in zip(found, kind) if k != _KNOWN]
        if rest:
            seed, tag, kinds = (np.concatenate(c) for c in zip(*rest))
            order = np.argsort(seed, kind="stable")
            seed, tag, kinds = seed[order], tag[order].astype(np.int64), kinds[order]
            begins = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
            docs = np.add.reduceat(np.where(kinds == _ONE, 1, tag), begins)
            docs = np.repeat(docs, np.diff(np.append(begins, len(seed))))
            # The documents of a task that met a seed in several know of it: its row has no tag.
            shared = docs > 1
            out.append((tag[shared], seed[shared], docs[shared], (kinds == _MANY)[shared]))
        for tag, seed, docs, none in out:
            low = (seed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for begin in range(0, len(low), 1 << 16):
                own = slice(begin, begin + (1 << 16))
                tags = pa.array(tag[own].astype(np.uint32).view(np.int32), mask=none[own])
                seeds = pa.array(low[own].view(np.int32))
                yield pa.RecordBatch.from_arrays([tags, seeds, pa.array(docs[own])], schema=_SHARED)


def shared_seeds(docs: DataFrame) -> DataFrame:
    """(tag, seed, docs) of :func:`_meet`, written once; ``docs``: tag, text."""
    cells = reading_tasks(docs.sparkSession) * CELLS_PER_TASK
    sent = docs.mapInArrow(_gather(cells), "cell int, kind int, blob binary")
    met = sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet, "tag int, seed int, docs bigint")
    return store(met, "shared-seeds")


def hot_seeds(shared: DataFrame) -> np.ndarray:
    """The seeds in too many documents for one task: HOT_SHARE at most, as each has its share of all."""
    total = shared.agg(F.coalesce(F.sum(F.greatest("docs", F.lit(1))), F.lit(0)).alias("n")).first().n
    limit = max(HOT_LEAST, total // HOT_SHARE)
    # A seed's rows hold its count once per task or document, so it is taken once.
    often = shared.filter(F.col("docs") > limit).select("seed").distinct()
    return np.sort(np.array([r.seed for r in often.collect()], np.int64))


# --- suffixes of shared anchors -----------------------------------------------------------------------

_SUFFIX = pa.schema(
    [("seed", pa.int64()), ("doc", pa.int64()), ("k2", pa.int64()), ("span", pa.int64()), ("around", pa.binary())]
)
_SUFFIX_COLUMNS = "seed bigint, doc bigint, k2 bigint, span bigint, around binary"


def _suffixes(hot: np.ndarray):
    """The text around each anchor whose seed another document has: the suffix and what is left of it.

    Of equal rows of a task those of larger documents than one before are decided and carry no text, so
    of a group of copies a task sends a few, however many it has.
    """

    def run(batches):
        known: dict[tuple[bytes, int, int], int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_py() or b"" for t in part.column("text").cast(pa.binary())]
                seeds = part.column("seeds")
                sizes = seeds.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                wanted = seeds.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
                wanted = np.unique(np.repeat(np.arange(len(texts)), sizes) << 32 | wanted)
                docs, keys = part.column("doc").to_numpy(), part.column("k2").to_numpy()
                for raw, piece, rows, places, begins in blocks(texts):
                    yield from around(raw, piece, rows, places, begins, wanted, docs, keys, known)

    def around(raw, piece, rows, places, begins, wanted, docs, keys, known):
        found, place, low, high = anchors(raw, piece)
        low32 = (found >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = rows[piece[place]] << 32 | low32
        near = np.minimum(np.searchsorted(wanted, own), max(len(wanted) - 1, 0))
        keep = np.flatnonzero(wanted[near] == own) if len(wanted) else np.zeros(0, np.int64)
        if not len(keep):
            return
        found, place, low, high, low32 = (x[keep] for x in (found, place, low, high, low32))
        seed = (found >> np.uint64(16)).astype(np.int64)
        many = np.isin(low32.astype(np.uint32).view(np.int32), hot)
        if many.any():
            # One row for each window, dealt by its content.
            count = np.where(many, high - low + 1, 1)
            at = np.repeat(np.arange(len(seed)), count)
            step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            alone = many[at]
            place, high, low, seed = place[at], np.where(alone, high[at] - step, high[at]), low[at], seed[at]
            low = np.where(alone, high, low)
            content = run_hashes(raw, WINDOW)[place - high] + high.astype(np.uint64)
            seed = np.where(alone, (_mix(content) >> np.uint64(16)).astype(np.int64), seed)
        first = place - high
        row = rows[piece[place]]
        doc, key = docs[row], keys[row]
        size = high - low + WINDOW
        text = raw.tobytes()
        pieces = [text[b : b + n] for b, n in zip(first.tolist(), size.tolist())]
        # Documents go from the smallest up; one whose text a smaller one of this task has is decided.
        decided = np.zeros(len(pieces), bool)
        if len(known) > KNOWN_TEXTS:
            known.clear()
        for i in np.argsort(doc, kind="stable").tolist():
            own, key_i = int(doc[i]), (pieces[i], int(high[i]), int(seed[i]))
            least = known.get(key_i, own)
            if least < own:
                decided[i] = True
            else:
                known[key_i] = own
        span = (places[piece[place]] + place - begins[piece[place]]) << 16 | low << 8 | high
        seed = np.where(decided, _mix(doc.astype(np.uint64) ^ key.astype(np.uint64)).astype(np.int64), seed)
        texts = [b"" if d else p for d, p in zip(decided.tolist(), pieces)]
        for begin in range(0, len(texts), 1 << 14):
            one = slice(begin, begin + (1 << 14))
            columns = [pa.array(c[one]) for c in (seed, doc, key, span)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts[one], pa.binary())], schema=_SUFFIX)

    return run


class BlindTrie:
    """A trie that keeps at each branch the place of the first difference only.

    A string is let down by these places alone, compared once with the string it ends at, and
    put in where that comparison differs.
    """

    END = -1

    def __init__(self, depth: int) -> None:
        self.depth, self.root, self.strings = depth, None, []

    def add(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = self._leaf(text, item)
            return
        node = self.root
        while node[0] >= 0:
            sign = text[node[0]] if node[0] < len(text) else self.END
            node = node[1].get(sign) or next(iter(node[1].values()))
        other = node[1]
        at, end = self.depth, min(len(text), len(other))
        while at < end and text[at] == other[at]:
            at += 1
        if at == len(text) == len(other):
            node[2].append(item)
            return
        above, sign, node = None, None, self.root
        while 0 <= node[0] < at:
            above, sign = node, text[node[0]] if node[0] < len(text) else self.END
            node = node[1][sign]
        if node[0] == at:
            node[1][text[at] if at < len(text) else self.END] = self._leaf(text, item)
            return
        branch = (
            at,
            {
                other[at] if at < len(other) else self.END: node,
                text[at] if at < len(text) else self.END: self._leaf(text, item),
            },
        )
        if above is None:
            self.root = branch
        else:
            above[1][sign] = branch

    @staticmethod
    def _leaf(text: bytes, item: int):
        return (-1, text, [item])

    def items(self) -> list[int]:
        """Items in the order of their strings."""
        out, waiting = [], [self.root] if self.root else []
        while waiting:
            node = waiting.pop()
            if node[0] < 0:
                out += node[2]
            else:
                waiting += [node[1][sign] for sign in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], group: np.ndarray) -> np.ndarray:
    """Order of strings by group, then content. ``group`` ascends; strings are WIDE bytes at most.

    Multikey quicksort on letters of 8 bytes, all parts of a round at once: each part is split by
    the letter of its middle string into smaller, equal and larger ones, and the equal ones go on with
    the next letter. Parts still equal after SHALLOW bytes are put in order by blind tries.
    """
    count = len(strings)
    order = np.arange(count)
    wide = np.zeros((count, WIDE), np.uint8)
    for i, s in enumerate(strings):
        wide[i, : len(s)] = np.frombuffer(s, np.uint8)
    letters = wide.view(">u8").astype(np.uint64)
    # Parts to split: begin, end, letter they are compared by.
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if count else np.zeros(0, np.int64)
    begin, end = edges, np.append(edges[1:], count)[: len(edges)]
    depth = np.zeros(len(begin), np.int64)
    deep: list[tuple[int, int]] = []
    while True:
        done = (depth >= SHALLOW // 8) & (end - begin > 1)
        deep += zip(begin[done].tolist(), end[done].tolist())
        open_ = ~done & (end - begin > 1)
        begin, end, depth = begin[open_], end[open_], depth[open_]
        if not len(begin):
            break
        sizes = end - begin
        part = np.repeat(np.arange(len(begin)), sizes)
        at = np.arange(len(part)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        own = letters[order[at], depth[part]]
        pivot = letters[order[(begin + end) // 2], depth][part]
        side = (own > pivot).astype(np.int64) + (own >= pivot)
        moved = np.lexsort((side, part))
        order[at] = order[at[moved]]
        below = np.bincount(part[side == 0], minlength=len(begin))
        equal = np.bincount(part[side == 1], minlength=len(begin))
        one, two = begin + below, begin + below + equal
        begin, end, depth = (
            np.concatenate([begin, one, two]),
            np.concatenate([one, two, end]),
            np.concatenate([depth, depth + 1, depth]),
        )
    for b, e in deep:
        trie = BlindTrie(0)
        for i in order[b:e].tolist():
            trie.add(strings[i], i)
        order[b:e] = trie.items()
    return order


def shared_prefixes(strings: list[bytes], order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each string of ``order`` has in common with the one before it; -1 at a new group."""
    out = np.full(len(order), -1, np.int64)
    if len(order) < 2:
        return out
    wide = np.zeros((len(order), WIDE + 1), np.uint8)
    sizes = np.fromiter((len(strings[i]) for i in order), np.int64, len(order))
    for i, s in enumerate(order):
        wide[i, : sizes[i]] = np.frombuffer(strings[s], np.uint8)
    differs = wide[1:] != wide[:-1]
    differs[:, WIDE] = True
    equal = np.minimum(differs.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    own = group[order]
    out[1:] = np.where(own[1:] == own[:-1], equal, -1)
    return out


def decided_windows(around: list[bytes], group: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Which windows of each row a smaller document has: (row, bytes of the window before the anchor).

    Rows are in the order of group and document. Suffixes from the anchor and, backwards, what lies
    before it are put in order; two rows share the window with d bytes before the anchor if their
    suffixes share WINDOW - d bytes and the texts before it d. For each d the rows with that window
    fall into classes by both orders, and all but the smallest document of a class lose it.
    """
    right = [t[h:] for t, h in zip(around, high.tolist())]
    left = [t[:h][::-1] for t, h in zip(around, high.tolist())]
    by_right, by_left = deep_shallow(right, group), deep_shallow(left, group)
    ahead = shared_prefixes(right, by_right, group)
    behind = shared_prefixes(left, by_left, group)
    rows, places = [], []
    for d in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        has = np.flatnonzero((low <= d) & (d <= high))
        if len(has) < 2:
            continue
        class_right, class_left = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        class_right[by_right] = np.cumsum(ahead < WINDOW - d)
        class_left[by_left] = np.cumsum(behind < d)
        both = class_right[has] * (len(group) + 1) + class_left[has]
        _, first, back = np.unique(both, return_index=True, return_inverse=True)
        gone = has[doc[has] > doc[has[first[back]]]]
        rows.append(gone)
        places.append(np.full(len(gone), d))
    if not rows:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate(rows), np.concatenate(places)


_HIT = pa.schema([("doc", pa.int64()), ("k2", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _sorted_matches(batches):
    """Stretches of bytes to remove: (doc, k2, begin, end), from rows in the order of seed and document.

    Rows whose text equals that of a row before them are decided as they come, so what is held of a
    seed are its different texts; those of a hot seed are all alike.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        old = 0 if held is None else held.num_rows
        seed, doc, k2, span = (rows.column(c).to_numpy() for c in ("seed", "doc", "k2", "span"))
        if not len(seed):
            continue
        texts = rows.column("around").to_pylist()
        place, low, high = span >> 16, span >> 8 & 255, span & 255
        whole = np.zeros(len(seed), bool)
        fresh = np.ones(len(seed), bool)
        first: dict = {}
        for i, key in enumerate(zip(seed.tolist(), (span & 0xFFFF).tolist(), texts)):
            if not key[2]:
                whole[i], fresh[i] = True, False
            elif (other := first.setdefault(key, i)) != i:
                whole[i] = doc[i] > doc[other]
                # A place in the same document waits for its own fate, unless all rows are alike.
                fresh[i] = doc[i] == doc[other] and low[i] < high[i]
        whole[:old] = False
        open_ = fresh & (seed == seed[-1])
        yield _hits(doc, k2, place, np.flatnonzero(whole), low[whole], high[whole])
        ready = np.flatnonzero(fresh & ~open_)
        yield _matches(texts, seed, doc, k2, place, low, high, ready)
        held = rows.take(pa.array(np.flatnonzero(open_)))
    if held is not None and held.num_rows:
        seed, doc, k2, span = (held.column(c).to_numpy() for c in ("seed", "doc", "k2", "span"))
        texts = held.column("around").to_pylist()
        parts = (span >> 16, span >> 8 & 255, span & 255)
        yield _matches(texts, seed, doc, k2, *parts, np.arange(len(seed)))


def _matches(texts, seed, doc, k2, place, low, high, rows):
    same = np.zeros(len(rows), bool)
    own = seed[rows]
    same[1:] = own[1:] == own[:-1]
    same[:-1] |= same[1:]
    rows = rows[same]
    around = [texts[i] for i in rows]
    at, d = decided_windows(around, seed[rows], doc[rows], low[rows], high[rows])
    if not len(at):
        return _hits(doc, k2, place, at, d, d)
    # Windows of one anchor overlap, so the first and the last of them bound what is removed.
    order = np.lexsort((d, at))
    at, d = at[order], d[order]
    begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return _hits(doc, k2, place, rows[at[begins]], np.minimum.reduceat(d, begins), np.maximum.reduceat(d, begins))


def _hits(doc, k2, place, rows, low, high):
    begin, end = place[rows] - high, place[rows] - low + WINDOW
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[rows], k2[rows], begin, end)], schema=_HIT)


# --- removal ------------------------------------------------------------------------------------------

_ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
_ADDED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]


def _merged(hits: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) joined where they overlap or touch."""
    hits = hits[np.argsort(hits[:, 0], kind="stable")]
    reach = np.maximum.accumulate(hits[:, 1])
    begins = np.flatnonzero(np.append(True, hits[1:, 0] > reach[:-1]))
    return list(zip(hits[begins, 0].tolist(), reach[np.append(begins[1:], len(hits)) - 1].tolist()))


def _remove(kept: list[str], with_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_py() or b"" for t in part.column("text").cast(pa.binary())]
                hits = part.column("hits")
                sizes = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = hits.flatten()
                row = np.repeat(np.arange(len(texts)), sizes)
                docs, keys = part.column("doc").to_numpy(), part.column("k2").to_numpy()
                own = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)] if len(row) else [row] * 4
                # Hits come by tag; those of this row have its key.
                mine = (own[0] == docs[row]) & (own[1] == keys[row])
                row, spans = row[mine], np.stack([own[2][mine], own[3][mine]], axis=1)
                edges = np.searchsorted(row, np.arange(len(texts) + 1))
                out, rest = [], []
                for i, raw in enumerate(texts):
                    gone = _merged(spans[edges[i] : edges[i + 1]]) if edges[i] < edges[i + 1] else []
                    left = raw
                    if gone:
                        cuts = [0, *(x for pair in gone for x in pair), len(raw)]
                        left = b"".join(raw[b:e] for b, e in zip(cuts[::2], cuts[1::2]))
                    found = [{"begin": b, "end": e} for b, e in gone]
                    out.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), found))
                    rest.append(left)
                columns = [pa.array(c, k) for c, k in zip(zip(*out), _ADDED_TYPES)]
                if with_text:
                    columns.append(pa.array(rest, pa.binary()))
                names = [*kept, *_ADDED, *(["kept"] if with_text else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=names)

    return run


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Bytes removed that a string of WINDOW bytes covers which also starts in a smaller doc_id.

    A suffix array of all bytes would hold each text WINDOW times over, so it is sparse: each window of
    WINDOW bytes chooses one seed of SEED bytes in it as its anchor, equal windows choose alike, and
    only suffixes at anchors are sorted. First seeds that only one document has are set
    aside: hashes of all anchors meet in cells, packed, and each document is told which of its seeds
    another has. The text around these anchors goes to the task of the seed. There the suffixes are
    sorted deep-shallow (:func:`deep_shallow`), and so, backwards, is the text before the anchor; the
    bytes that neighbours have in common tell which windows are equal (:func:`decided_windows`).
    Hashes only choose what is compared: bytes are removed where the texts themselves are equal.

    Documents of one task that share a text around an anchor send it once. Seeds in very many
    documents (HOT_SHARE at most) are sent window by window, each to the task of its own content, and
    there only different texts are held.

    Returns doc_id (with ``with_text`` all columns of ``docs``, and the bytes ``kept``), n_bytes,
    n_removed, n_spans (stretches removed), kept_sha256 and ``removed``, the stretches. What is left
    need not be text, as a stretch may end inside a character.

    A null or empty text has no bytes and the hash of no bytes. A null doc_id is larger than all others.
    Rows that share a doc_id remove nothing from each other; exact repeats lose the same bytes. Texts of any
    length are read in blocks. An empty table gives an empty result; columns of ``docs`` named like
    the added ones are replaced.
    """
    plain = docs.drop(*_ADDED, *(["kept"] if with_text else []))
    kept = plain.columns if with_text else ["doc_id"]
    names = ["text" if c == "text" else f"c_{i}" for i, c in enumerate(kept)]
    keyed = with_row_key(plain).select(
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, kept) if n != "text"],
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.col("_k2").alias("k2"),
        "text",
    )
    # The tag brings what belongs to a document to it; should two share one, doc and k2 tell.
    keyed = keyed.withColumn("tag", F.hash("doc", "k2"))
    shared = shared_seeds(keyed.select("tag", "text"))
    hot = hot_seeds(shared)
    seeds = shared.filter("tag is not null").groupBy("tag").agg(F.collect_list("seed").alias("seeds"))
    # Both joins take the same columns, so Spark deals the texts by tag once for the two of them.
    around = keyed.join(seeds, "tag").mapInArrow(_suffixes(hot), _SUFFIX_COLUMNS)
    found = (
        around.repartition("seed")
        .sortWithinPartitions("seed", "doc")
        .mapInArrow(_sorted_matches, "doc bigint, k2 bigint, begin bigint, end bigint")
    )
    hits = found.groupBy(F.hash("doc", "k2").alias("tag")).agg(F.collect_list(F.struct("doc", "k2", "begin", "end")).alias("hits"))
    joined = keyed.join(hits, "tag", "left")
    types = dict(plain.dtypes)
    columns = [f"`{n}` {types[c]}" for n, c in zip(names, kept)]
    columns += ["n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"]
    columns += ["removed array<struct<begin bigint, end bigint>>"] + ["kept binary"] * with_text
    result = joined.mapInArrow(_remove(names, with_text), ", ".join(columns))
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], *_ADDED, *(["kept"] if with_text else []))
