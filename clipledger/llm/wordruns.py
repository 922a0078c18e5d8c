"""Periodic runs of words, from Lyndon roots that Baier's grouping finds."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipledger.llm.common import slices

LEAST = 12
# Rounds in which words that cannot lie in a run are set aside. Fewer leave more to sort, no more.
ROUNDS = 4


def lyndon_lengths(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    First phase of Baier's suffix sorter. Places are grouped by their first letter, and groups are
    taken from the highest down. Each place of the group points to the nearest place before it that
    has not been taken; pointed-to places with equal numbers of pointers leave their group for a
    new one directly above it, whose common prefix is the old one and the prefixes of the
    pointers. When a group is taken its prefix is the longest Lyndon word of its places. Each place
    points once, so the work is linear but for sorting the letters.
    """
    n = len(letters)
    first: dict[int, list[int]] = {}
    for place, letter in enumerate(letters):
        first.setdefault(letter, []).append(place)
    # Groups by number; a place that has moved on stays in the list of its old group.
    places = [first[letter] for letter in sorted(first)]
    lengths = [1] * len(places)
    lower, upper = list(range(-1, len(places) - 1)), [*range(1, len(places)), -1]
    group = [0] * n
    for number, own in enumerate(places):
        for place in own:
            group[place] = number
    # The places not taken yet, as a list linked both ways.
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    at = len(places) - 1
    while at >= 0:
        size, last, pointers, pointed = lengths[at], -1, 0, []
        for place in places[at]:
            if group[place] != at:
                continue
            out[place] = size
            before, after = left[place], right[place]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                if before == last:
                    pointers += 1
                else:
                    if last >= 0:
                        pointed.append((group[last], pointers, last))
                    last, pointers = before, 1
        if last >= 0:
            pointed.append((group[last], pointers, last))
        moved: dict[tuple[int, int], list[int]] = {}
        for old, pointers, place in pointed:
            moved.setdefault((old, pointers), []).append(place)
        # More pointers rank higher, and each new group goes directly above its old one.
        for old, pointers in sorted(moved, reverse=True):
            number, above = len(places), upper[old]
            places.append(moved[old, pointers])
            lengths.append(lengths[old] + pointers * size)
            lower.append(old)
            upper.append(above)
            upper[old] = number
            lower[above] = number
            for place in places[number]:
                group[place] = number
        at = lower[at]
    return out


def block_names(letters: np.ndarray) -> list[np.ndarray]:
    """``[k][i]``: a number for the 2**k letters from place i on, equal for equal ones only.

    Ends where all blocks differ or a longer one does not fit.
    """
    names, width = [np.unique(letters, return_inverse=True)[1]], 1
    while 2 * width <= len(letters):
        shorter = names[-1]
        pairs = shorter[:-width] * (int(shorter.max()) + 1) + shorter[width:]
        different, numbers = np.unique(pairs, return_inverse=True)
        names.append(numbers.astype(np.int64))
        width *= 2
        if len(different) == len(numbers):
            break
    return names


def common_extension(names: list[np.ndarray], one: np.ndarray, two: np.ndarray, back: bool) -> np.ndarray:
    """Equal letters from places ``one`` and ``two`` (larger) on, or before them if ``back``."""
    n = len(names[0])
    total = np.zeros(len(one), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        if back:
            a, b = one - total - width, two - total - width
            fits = a >= 0
        else:
            a, b = one + total, two + total
            fits = b + width <= n
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        total += np.where(fits & (names[k][a] == names[k][b]), width, 0)
    return total


def runs_of(letters: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of the maximal runs of at least two periods and ``least`` letters.

    ``letters``: numbers from 0 on; negative ones are borders, each used once, that count as lower
    than all letters in both orders. Every run has a root that is the longest Lyndon word at its
    place under one of the two orders of the letters, so each Lyndon word is extended both ways by
    the letters it has in common with its next occurrence; equal results are one run.
    """
    border = letters < 0
    ranks = np.where(border, letters, np.unique(letters, return_inverse=True)[1])
    turned = np.where(border, letters, int(ranks.max(initial=0)) - ranks)
    names = block_names(letters)
    found = []
    place = np.arange(len(letters))
    for order in (ranks, turned):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)
        start = place - common_extension(names, place, place + period, back=True)
        end = place + period + common_extension(names, place, place + period, back=False)
        good = (end - start >= 2 * period) & (end - start >= least) & ~border
        found.append(np.stack([start[good], (end - start)[good], period[good]], axis=1))
    both = np.concatenate(found)
    return np.unique(both, axis=0) if len(both) else both


def can_repeat(codes: np.ndarray, parts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that can lie in a run and the part each belongs to; ``codes``: words, by document in ``parts``.

    A word of a run occurs in it twice. So a word found once in its part lies in no run, and a run
    that ends beside it cannot go on there: it cuts the part in two. Parts shorter than ``least`` hold
    no run.
    """
    at = np.arange(len(codes))
    width = int(codes.max(initial=0)) + 1
    for _ in range(ROUNDS):
        _, back, times = np.unique(parts * width + codes, return_inverse=True, return_counts=True)
        again = times[back] > 1
        place, old = at[again], parts[again]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1] + 1) | (old[1:] != old[:-1])
        number = np.cumsum(fresh) - 1
        enough = np.bincount(number, minlength=1)[number] >= least if len(place) else again[:0]
        same = len(at) == int(enough.sum())
        at, parts, codes = place[enough], number[enough], codes[again][enough]
        if same:
            break
    return at, parts


def batch_runs(codes: np.ndarray, parts: np.ndarray, least: int) -> np.ndarray:
    """(place, length, period) of all runs of a batch of documents, by place, then period."""
    at, parts = can_repeat(codes, parts, least)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # The parts one after the other, each ended by a border of its own.
    number = np.cumsum(np.concatenate([[0], (parts[1:] != parts[:-1]).astype(np.int64)]))
    letters = np.arange(-1, -(len(at) + int(number[-1]) + 2), -1, dtype=np.int64)
    spot = np.arange(len(at)) + number
    letters[spot] = codes[at]
    place = np.zeros(len(letters), np.int64)
    place[spot] = at
    found = runs_of(letters, least)
    found[:, 0] = place[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = ["n_words", "runs", "collapsed"]


def _rows(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
    words = [t.split() for t in raw]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    # A word's number is the place in its document where it first occurs.
    codes = [np.fromiter(map({}.setdefault, own, count()), np.int64, len(own)) for own in words]
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    found = batch_runs(codes, np.repeat(np.arange(len(sizes)), sizes), least)
    places, lengths, periods = found.T
    rows = np.searchsorted(begin, places, "right") - 1
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, places + periods, 1)
    np.add.at(change, places + lengths, -1)
    dropped = np.cumsum(change[:-1]) > 0
    kept = []
    for i, own in enumerate(words):
        gone = dropped[begin[i] : begin[i] + sizes[i]]
        kept.append(b" ".join([w for w, d in zip(own, gone.tolist()) if not d] if gone.any() else own))
    offsets = np.searchsorted(rows, np.arange(len(words) + 1)).astype(np.int32)
    parts = pa.StructArray.from_arrays(
        [pa.array(places - begin[rows]), pa.array(lengths), pa.array(periods)], fields=list(_RUN)
    )
    runs = pa.ListArray.from_arrays(pa.array(offsets), parts)
    columns = [pa.array(sizes), runs, pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *_ADDED])


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with n_words, their ``runs`` of words and the text ``collapsed``.

    A run (start, length, period) is a stretch of words in which words ``period`` apart are
    identical, with ``period`` the smallest such number, of at least two periods and ``least``
    words, that no neighbouring word extends. Runs come by start, then period. ``collapsed`` has
    the words joined by one blank, without those that follow the first period of a run.

    Each document is handled in the task that reads it, so nothing is shuffled. Words that occur
    once are set aside first (:func:`can_repeat`); what is left goes through Baier's grouping under
    both orders of the words. Memory follows the longest text.

    A null or empty text has no words, no runs and an empty ``collapsed``. Nulls elsewhere, ties and
    repeated rows change nothing: each row is taken on its own. An empty table gives an empty
    result; columns of ``docs`` named like the added ones are replaced.
    """
    rows = docs.drop(*_ADDED)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    columns += ["n_words bigint", "runs array<struct<start bigint, length bigint, period bigint>>", "collapsed string"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _rows(part, least)

    return rows.mapInArrow(run, ", ".join(columns))
