"""SimHash near-dedup: fingerprints, BK-trees over shards of them, connected classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import by_slices, components, whole_groups, with_row_key
from clipledger.session import store

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# Nodes of one BK-tree.
TREE = 4096
# Fingerprints a shard should hold on average before keys get longer.
SHARD = 64

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("fp", pa.int64())])
_WORD = (1 << BITS) - 1
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number; 0 without words."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the blanks 09-0D and 20.
    words = text.lower().split()
    if not words:
        return 0
    count = max(len(words) - shingle + 1, 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    last = np.minimum(np.arange(count) + shingle - 1, len(words) - 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(line[i:j], SEED) for i, j in zip(starts[:count].tolist(), stops[last].tolist(), strict=True)]
    )
    rows = np.frombuffer(hashes, np.uint8).reshape(count, 8)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, count, 1 << 16):
        ones += np.unpackbits(rows[begin : begin + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def _fingerprints(batch: pa.RecordBatch) -> dict:
    texts = batch.column("text").cast(pa.binary())
    return {
        "doc_id": batch.column("doc_id"),
        "_k1": batch.column("_k1"),
        "_k2": batch.column("_k2"),
        "fp": [fingerprint(t.as_py() or b"") for t in texts],
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, fp) of every row, written once: three later steps read it."""
    rows = with_row_key(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_k1", "_k2", "text")
    schema = "doc_id bigint, _k1 bigint, _k2 bigint, fp bigint"
    return store(rows.mapInArrow(by_slices(_fingerprints, _SCHEMA), schema), "simhash")


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of which one at least hides every difference of ``radius`` bits at most.

    64 bits fall into ``blocks`` blocks; ``radius`` differing bits touch that many blocks at most,
    so two linked fingerprints agree on all bits of some choice of the others.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    masks = []

    def choose(begin: int, left: int, mask: int) -> None:
        if not left:
            masks.append(mask)
            return
        for i in range(begin, blocks - left + 1):
            choose(i + 1, left - 1, mask | parts[i])

    choose(0, blocks - radius, 0)
    return masks


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """As few blocks as keep an average shard below SHARD. Any number gives the same links."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct / 2 ** (BITS * (blocks - radius) / blocks) > SHARD:
        blocks += 1
    return blocks


class BKTree:
    """A Burkhard-Keller tree of unsigned numbers: children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            child = self.children[at].setdefault(distance, len(self.values) - 1)
            if child == len(self.values) - 1:
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most ``radius`` away; only edges that can lead there are taken."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for d, c in children.items() if -radius <= d - distance <= radius]
            else:
                todo += [
                    children[d] for d in range(distance - radius, distance + radius + 1) if d in children
                ]
        return found


# A shard's blocks meet in pairs: the first is a tree, the second looks into it.
_FACING = ["mask", "part", "one", "two"]


def _links(radius: int):
    def run(batches):
        for group in whole_groups(batches, _FACING):
            keys = [group.column(k).to_numpy() for k in _FACING]
            fps = group.column("fp").to_pylist()
            nodes, looks = group.column("node").to_pylist(), group.column("look").to_pylist()
            new = np.zeros(len(fps), bool)
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(fps)]
            left, right = [], []
            for begin, end in zip(cuts, cuts[1:]):
                if end - begin < 2:
                    continue
                members = fps[begin:end]
                # Distances count bits of unsigned numbers.
                plain = [m & _WORD for m in members]
                root = list(range(end - begin))

                def top(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                tree, held = BKTree(), []
                for i in range(end - begin):
                    if nodes[begin + i]:
                        tree.add(plain[i])
                        held.append(i)
                for i in range(end - begin):
                    for j in tree.within(plain[i], radius) if looks[begin + i] else ():
                        a, b = top(i), top(held[j])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                # A tree of links per shard tells all that is needed of the pairs inside.
                for i in range(end - begin):
                    if top(i) != i:
                        left.append(members[i])
                        right.append(members[top(i)])
            yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema=_EDGES)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp) with ``radius`` or fewer differing bits.

    Fingerprints that may be linked share a shard: a choice of bit blocks and their values. A
    shard of more than TREE fingerprints is dealt over several blocks, each of which is a tree. Blocks
    meet in pairs, the second looking into the tree of the first, so no group holds more than two of them.
    """
    masks = block_masks(blocks_for(distinct.count(), radius), radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed]))
    ).toDF("fp", "mask", "part")
    sizes = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    trees = F.ceil(F.col("n") / F.lit(TREE)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    rows = (
        keyed.join(sizes, ["mask", "part"])
        .withColumn("trees", trees)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
        .select(*_FACING, "fp", (F.col("own") == F.col("one")).alias("node"), (F.col("own") == F.col("two")).alias("look"))
    )
    keys = _FACING
    return (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys, "fp")
        .mapInArrow(_links(radius), "a bigint, b bigint")
        .distinct()
    )


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _k1, _k2, fp, root, component_id) for every row of ``docs``; root names the class.

    Equal fingerprints are one node, so copies are never expanded into pairs. component_id is the
    smallest doc_id of all rows reachable by links. Null and empty texts have fingerprint 0 and
    link like others. Repeated rows share all values. Null doc_ids never are a component_id, unless
    a component has no other: then it is null. An empty table gives an empty result; other columns
    are not looked at.
    """
    rows = fingerprints(docs)
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    found = components(fingerprint_links(classes.select("fp"), radius), "simhash-links")
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    mapped = rooted.select("fp", "root").join(lowest, "root")
    return rows.join(mapped, "fp")


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` of which one per class stays: the smallest doc_id, nulls last.

    Rows that tie in doc_id are told apart by their text; exact repeats of a row leave one.
    """
    classes = near_classes(docs, radius)
    place = F.struct(F.col("doc_id").isNull(), "_k1", "_k2")
    first = classes.groupBy("root").agg(F.min(place).alias("p"))
    stay = first.select(F.col("p._k1").alias("_k1"), F.col("p._k2").alias("_k2"))
    kept = with_row_key(docs).join(stay, ["_k1", "_k2"])
    return kept.dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
