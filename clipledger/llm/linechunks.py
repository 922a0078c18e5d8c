"""Line dedup by content-defined chunks of lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import text_or_empty, with_row_key
from clipledger.session import store

# A line ends a chunk if the rolling hash over it and the line before is 0 modulo this.
DIVISOR = 3
ROLL = 31
LINE_HASH_DIGITS = 7
MIN_LINES = 2


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, LINE_HASH_DIGITS), 16, 10).cast("bigint")


def chunked(text: Column) -> Column:
    """The chunks of a text as array<struct<idx, start, n, body>>; ``start`` counts lines from 0.

    The rolling hash of line i is 31 * hash(i - 1) + hash(i), so a boundary depends on two lines
    only and an inserted line moves no boundary beyond its neighbours.
    """

    def with_lines(lines: Column) -> Column:
        last = F.size(lines) - 1
        hashes = F.transform(lines, _hash)

        def with_hashes(h: Column) -> Column:
            rolled = lambda i: F.element_at(h, i) * ROLL + F.element_at(h, i + 1)
            ends = F.filter(
                F.sequence(F.lit(0), last),
                lambda i: (i == last)
                | F.coalesce(F.when(i > 0, F.pmod(rolled(i), F.lit(DIVISOR)) == 0), F.lit(False)),
            )

            def chunk_of(e: Column, end: Column, k: Column) -> Column:
                start = F.when(k == 0, 0).otherwise(F.element_at(e, F.greatest(k, F.lit(1))) + 1)
                return F.struct(
                    k.alias("idx"),
                    start.alias("start"),
                    (end - start + 1).alias("n"),
                    F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("body"),
                )

            return _let(ends, lambda e: F.transform(e, lambda end, k: chunk_of(e, end, k)))

        return _let(hashes, with_hashes)

    return _let(F.split(text, "\n"), with_lines)


def _let(value: Column, function) -> Column:
    """``function(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _eligible(chunk: Column) -> Column:
    """Chunks of two lines or more that hold text in at least two of them."""
    return (chunk["n"] >= MIN_LINES) & chunk["body"].rlike(r"\S[^\n]*\n(?s:.*)\S")


def repeated_chunks(keyed: DataFrame) -> DataFrame:
    """Per row key the chunks to remove: (_k1, _k2, _gone: array of chunk numbers).

    ``keyed`` has _k1, _k2 and ``text``. First only hashes are shuffled and counted; the bytes of
    chunks whose hash repeats are then compared class by class, pre-aggregated, so that a chunk in
    a third of all documents meets in no task. The occurrence with the smallest (doc_id, row key,
    chunk number) stays.
    """
    found = keyed.select("_k1", "_k2", F.explode(F.filter(chunked(F.col("text")), _eligible)).alias("c"))
    # Both are written, short rows as they are: chunks are hashed once, and the join below meets two
    # tables whose frequent hashes can be split.
    hashed = store(
        found.select("_k1", "_k2", F.col("c.idx").alias("idx"), _chunk_hash().alias("h")),
        "chunk-hashes",
    )
    twice = store(
        hashed.groupBy("h").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select("h"),
        "chunk-repeats",
    )
    wanted = _named(hashed.join(twice, "h"), "_wanted")
    place = F.struct("_k1", "_k2", "idx")
    bodies = _bodies(keyed, wanted)
    # Least and greatest body of a class are equal only if all its bodies are.
    checked = store(
        bodies.groupBy("h").agg(
            F.min(place).alias("_first"), (F.min("body") == F.max("body")).alias("_same")
        ),
        "chunk-classes",
    )
    again = hashed.join(checked.filter("_same"), "h").filter(place > F.col("_first"))
    gone = again.select("_k1", "_k2", "idx")
    mixed = checked.filter("not _same").select("h")
    if not mixed.isEmpty():
        # Different chunks of one hash, which hardly ever happens: told apart by their bytes.
        chosen = _named(hashed.join(mixed, "h"), "_wanted")
        apart = store(_bodies(keyed, chosen), "chunk-bodies")
        first = store(apart.groupBy("body").agg(F.min(place).alias("_first")), "chunk-firsts")
        others = apart.join(first, "body").filter(place > F.col("_first"))
        gone = gone.unionByName(others.select("_k1", "_k2", "idx"))
    return _named(gone, "_gone")


def _named(chunks: DataFrame, name: str) -> DataFrame:
    """Per row key the numbers of its ``chunks``, each once: repeats of a row share its key."""
    once = chunks.select("_k1", "_k2", "idx").distinct()
    return once.groupBy("_k1", "_k2").agg(F.collect_list("idx").alias(name))


def _bodies(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hash and bytes of the chunks that ``wanted`` (_k1, _k2, _wanted) names."""
    found = keyed.join(wanted, ["_k1", "_k2"]).select(
        "_k1",
        "_k2",
        F.explode(
            F.filter(chunked(F.col("text")), lambda c: F.array_contains(F.col("_wanted"), c["idx"]))
        ).alias("c"),
    )
    return found.select(
        "_k1", "_k2", F.col("c.idx").alias("idx"), F.col("c.body").alias("body"), _chunk_hash().alias("h")
    )


def _chunk_hash() -> Column:
    return F.xxhash64("c.body", "c.n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with globally repeated chunks of lines removed from ``text``.

    Adds n_lines, n_chunks, n_removed_lines (bigint). A null text stays null with 0 lines; an
    empty text is one empty line. Rows that repeat doc_id and text are one document here: all of
    them get the same decision. Null doc_ids rank as 0 and are otherwise kept apart by text.
    Chunks are compared over all rows of ``docs``, each chunk in one occurrence stays. Columns of
    ``docs`` named like the added ones are replaced, an empty table gives an empty result.
    """
    keyed = with_row_key(docs.drop("n_lines", "n_chunks", "n_removed_lines"))
    slim = keyed.select("_k1", "_k2", text_or_empty().alias("text"))
    gone = repeated_chunks(slim)
    # Removed chunks of a row are joined to all its repeats.
    joined = keyed.join(gone, ["_k1", "_k2"], "left")
    chunks = joined.withColumn("_c", chunked(text_or_empty()))
    # Set operations on chunk numbers: their time follows the chunks of a text, not their square.
    none = F.array().cast("array<int>")
    numbers = F.sequence(F.lit(0), F.size("_c") - 1)
    lost = F.array_distinct(F.coalesce("_gone", none))
    kept = F.array_except(numbers, F.coalesce("_gone", none))
    lost_lines = F.aggregate(
        lost, F.lit(0).cast("bigint"), lambda n, i: n + F.get(F.col("_c"), i)["n"].cast("bigint")
    )
    lines = F.aggregate("_c", F.lit(0).cast("bigint"), lambda n, c: n + c["n"].cast("bigint"))
    absent = F.col("text").isNull()
    return chunks.withColumns(
        {
            "n_lines": F.when(absent, 0).otherwise(lines).cast("bigint"),
            "n_chunks": F.when(absent, 0).otherwise(F.size("_c")).cast("bigint"),
            "n_removed_lines": lost_lines,
            "text": F.when(absent, None).when(F.col("_gone").isNull(), F.col("text")).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get(F.col("_c"), i)["body"]), "\n")
            ),
        }
    ).drop("_k1", "_k2", "_gone", "_c")
