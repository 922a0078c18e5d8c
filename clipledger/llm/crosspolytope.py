"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import components, whole_groups
from clipledger.session import store

THRESHOLD = 0.98
TABLES = 6
# Hashes put together per table, and buckets probed per table (the own one included).
HASHES = 2
PROBES = 2
SEED = 20240607
# Members of one side of a compared pair of blocks.
BLOCK = 1024


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (length a power of two), not scaled."""
    n, width = rows.shape
    step = 1
    while step < width:
        view = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows


def bucket_codes(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """[rows, tables, probes] bucket numbers, the own bucket first, then the likeliest others.

    A rotation is three rounds of random signs and a Hadamard transform. A hash is the signed axis
    nearest to the rotated vector; a probe takes the second nearest axis in one hash or more,
    those first that lose the least.
    """
    n, dim = unit.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    random = np.random.default_rng(SEED + width)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        axes, losses = [], []
        for _ in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(turned)
            best = np.argpartition(-size, 1, axis=1)[:, :2]
            value = np.take_along_axis(size, best, 1)
            swap = value[:, 0] < value[:, 1]
            best[swap], value[swap] = best[swap][:, ::-1], value[swap][:, ::-1]
            sign = np.take_along_axis(turned, best, 1) < 0
            axes.append(best * 2 + sign)
            losses.append(value[:, 0] - value[:, 1])
        # Each choice of second axes is a probe; its loss is the sum of their losses.
        codes, loss = [], []
        for choice in range(1 << hashes):
            code, total = np.zeros(n, np.int64), np.zeros(n)
            for h in range(hashes):
                second = choice >> h & 1
                code = code * (2 * width) + axes[h][:, second]
                total = total + losses[h] * second
            codes.append(code)
            loss.append(total if choice else np.full(n, -1.0))
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")[:, :probes]
        out[:, t, : order.shape[1]] = np.take_along_axis(np.stack(codes, 1), order, 1)
        if order.shape[1] < probes:
            out[:, t, order.shape[1] :] = out[:, t, :1]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hashing(tables: int, hashes: int, probes: int):
    schema = pa.schema([("cid", pa.int64()), ("codes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("cid").to_numpy()
            dims = batch.column("dim").to_numpy()
            vectors = batch.column("vector")
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                taken = vectors.take(pa.array(rows)).flatten().to_numpy().astype(np.float64)
                codes = bucket_codes(_unit(taken.reshape(len(rows), dim)), tables, hashes, probes)
                flat = pa.array(codes.reshape(-1))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (tables * probes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.ListArray.from_arrays(offsets, flat)], schema=schema
                )

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of codes [pairs, tables, probes]: 3 * table + way of their first meeting.

    The ways: both own buckets; the first's probe at the second's own bucket; the reverse.
    """
    own = a[:, :, 0] == b[:, :, 0]
    ab = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    ba = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    ways = np.stack([own, ab, ba], axis=2).reshape(len(a), -1)
    return ways.argmax(axis=1)


_LINKED = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _compare(threshold: float, tables: int, probes: int):
    """Per group (a bucket, or two blocks of one): verified links, counted where they first meet."""

    def run(batches):
        for group in whole_groups(batches, ["lab", "tab", "code", "one", "two"]):
            group = group.combine_chunks()
            keys = [group.column(k).to_numpy() for k in ("lab", "tab", "code", "one", "two")]
            new = np.zeros(group.num_rows, bool)
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), group.num_rows]
            ids, times = group.column("cid").to_numpy(), group.column("times").to_numpy()
            own, blocks = group.column("own").to_numpy(), group.column("block").to_numpy()
            vectors, codes = group.column("vector"), group.column("codes")
            out = [[], [], []]
            for begin, end in zip(cuts, cuts[1:]):
                if end - begin < 2:
                    continue
                part = slice(begin, end)
                table, one, two = int(keys[1][begin]), int(keys[3][begin]), int(keys[4][begin])
                unit = _unit(
                    vectors.slice(begin, end - begin).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(end - begin, -1)
                )
                near = unit @ unit.T >= threshold
                i, j = np.nonzero(np.triu(near, 1))
                # One of the two is at home here; of two blocks, one is on each side.
                fits = own[part][i] | own[part][j]
                fits &= ids[part][i] != ids[part][j]
                if one != two:
                    fits &= blocks[part][i] != blocks[part][j]
                i, j = i[fits], j[fits]
                if not len(i):
                    continue
                code = codes.slice(begin, end - begin).combine_chunks().flatten().to_numpy()
                code = code.reshape(end - begin, tables, probes)
                home_i, home_j = own[part][i], own[part][j]
                way = np.where(home_i & home_j, 0, np.where(home_j, 1, 2))
                first = np.concatenate(
                    [_first_meeting(code[i[s : s + 65536]], code[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
                )
                # The pair is counted by its first table and way alone, so nowhere else.
                mine = first == 3 * table + way
                i, j = i[mine], j[mine]
                if not len(i):
                    continue
                own_ids, weight = ids[part], times[part]
                links = np.zeros(end - begin, np.int64)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = np.arange(end - begin)
                while True:
                    low = np.minimum(root[i], root[j])
                    before = root.copy()
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
                    root = root[root]
                    if (root == before).all():
                        break
                hit = np.flatnonzero(links)
                out[0].append(own_ids[hit])
                out[1].append(own_ids[root[hit]])
                out[2].append(links[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], schema=_LINKED
            )

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Vectors with equal labels link if their cosine is ``threshold`` or more. Equal vectors of a
    label are one class and never expanded. Classes meet in buckets, each in its own one and as a
    guest in its other probes; a bucket of more than BLOCK members is compared block by block.
    A link found is verified in double precision, and counted only where the pair meets first, so
    pairs are never written: a block tells each member its count of links and one member of its
    part of the component.

    A vector that is null, empty, zero, or holds null or non-finite numbers, or whose label is
    null, has no links and is its own component. Vectors of different length never link. Rows that
    repeat a vec_id count as vectors of their own and are one node of components; a null vec_id
    has a null component_id and is not kept. An empty table gives an empty result, other columns
    are not looked at.
    """
    bad = F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").alias("lab"), F.col("embedding").alias("vector")
    )
    usable = F.coalesce(
        F.col("lab").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    valid = rows.withColumn("usable", usable).withColumns(
        {
            "h1": F.when(F.col("usable"), F.xxhash64("vector", "lab")),
            "h2": F.when(F.col("usable"), F.xxhash64(F.lit(1), F.col("vector"), F.col("lab"))),
        }
    )
    classes = store(
        valid.filter("usable")
        .groupBy("h1", "h2")
        .agg(
            F.first("h1").alias("cid"),
            F.min("vec_id").alias("lowest"),
            F.count(F.lit(1)).alias("times"),
            F.first("lab").alias("lab"),
            F.first("vector").alias("vector"),
        ),
        "vector-classes",
    )
    slim = classes.select("cid", "h1", "h2", "times", F.xxhash64("lab").alias("lab"), F.size("vector").alias("dim"), "vector")
    hashed = slim.select("cid", "dim", "vector").mapInArrow(
        _hashing(tables, hashes, probes), "cid bigint, codes array<bigint>"
    )
    members = store(
        slim.join(hashed.dropDuplicates(["cid"]), "cid").withColumn("lab", F.xxhash64("lab", "dim")),
        "vector-codes",
    )
    places = F.posexplode(F.col("codes"))
    met = (
        members.select("cid", "lab", "codes", places.alias("at", "code"))
        .withColumn("tab", F.call_function("div", F.col("at"), F.lit(probes)).cast("int"))
        .withColumn("own", F.col("at") % probes == 0)
        .filter(F.col("own") | (F.col("code") != F.element_at("codes", (F.col("tab") * probes + 1).cast("int"))))
        .select("cid", "lab", "tab", "code", "own")
    )
    bucket = ["lab", "tab", "code"]
    sizes = (
        met.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("homes"))
        .filter("n > 1 and homes > 0")
    )
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    facing = (
        met.join(sizes, bucket)
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", pairs)
        .select(
            "cid",
            *bucket,
            "own",
            "block",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
        )
    )
    keys = [*bucket, "one", "two"]
    found = store(
        facing.join(members.select("cid", "times", "vector", "codes"), "cid")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "cid")
        .mapInArrow(_compare(threshold, tables, probes), "cid bigint, root bigint, links bigint"),
        "vector-links",
    )
    # A vec_id with different vectors is one node: it ties their classes together.
    named = valid.filter("usable and vec_id is not null").select("vec_id", F.col("h1").alias("cid")).distinct()
    shared = named.groupBy("vec_id").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least < most")
    ties = named.join(shared, "vec_id").filter("cid > least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    links = found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    roots = components(links.unionByName(ties), "vector-components")
    counts = found.groupBy("cid").agg(F.sum("links").alias("others"))
    named = (
        classes.select("cid", "h1", "h2", "times", "lowest")
        .join(counts, "cid", "left")
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component"))
    named = named.join(lowest, "root").select(
        F.col("h1"), F.col("h2"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"), "component"
    )
    joined = valid.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
