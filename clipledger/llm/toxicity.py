"""Toxicity: noisy-channel restoring of disguised words, then a lexicon learned from labels."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import by_slices, slices

THRESHOLD = 0.7
# Labelled rows of each class that the lexicon and its calibration are learned from, at most.
SAMPLE = 20_000
# Of every four of them, the last calibrates and the others make the lexicon.
PARTS = 4
# Features of toxic texts that are weighed, at most, and texts a feature needs.
LEXICON = 50_000
LEAST_WEIGHT = 0.3
LEAST_TEXTS = 2
# Texts of average toxicity that every feature is credited with, and how many standard deviations
# below its estimate a share is taken.
PRIOR = 2.0
CAUTION = 2.0
PREFIXES = (6, 5, 4)
# Restored spans a task keeps at hand, and letters of a span decoded at once.
KNOWN_SPANS = 100_000
SPAN = 400

# Fixed values of the channel: which letters a character may stand for.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "*": "aeiou",
}
SEPARATORS = " .-_*~"

# Channel costs, as natural logarithms.
SUBSTITUTE, DROP, DROP_INSIDE, SPLIT, REPEAT = -1.0, -2.0, -6.0, -3.0, -0.5

EDGE, OTHER, LETTERS = 0, 27, 28


def _letter_table() -> np.ndarray:
    """Code points of the first plane to letters: a-z by their base letter, OTHER, or EDGE."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            base = unicodedata.normalize("NFKD", char.lower())[:1]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(codes < 1 << 16, table[np.minimum(codes, (1 << 16) - 1)], OTHER)


# --- the language model ---------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over every text of ``docs``; LETTERS ** 3 numbers at most."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    def run(batches):
        table, counts = letter_table(), np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for begin in range(0, part.num_rows, 256):
                    texts = part.column("text").slice(begin, 256).to_pylist()
                    letters = _letters(_codes("\n" + "\n".join(t or "" for t in texts) + "\n"), table).astype(np.int32)
                    letters = letters[np.append(True, (letters[1:] != EDGE) | (letters[:-1] != EDGE))]
                    code = (letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:]
                    counts += np.bincount(code, minlength=LETTERS**3)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], schema=schema)

    sums = docs.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(LETTERS**3)
    for row in sums.collect():
        out[row.code] = row.n
    return out.reshape(LETTERS, LETTERS, LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two letters before), backed off to one letter and none."""
    single = counts.sum((0, 1)) + 1.0
    single = single / single.sum()
    pairs = counts.sum(0)
    pair = (pairs + 5 * single) / (pairs.sum(1, keepdims=True) + 5)
    full = (counts + 5 * pair[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(full).astype(np.float32)


# --- the channel ----------------------------------------------------------------------------------


def lattice(span: str, table: np.ndarray) -> list[list[tuple[tuple[int, ...], str, float]]]:
    """For each run of equal characters what it may stand for: (letters, their text, cost).

    A letter stands for itself; three or more of it also for two or one. A digit or sign stands
    for a letter, for nothing, or for an end of word; a separator for nothing or an end of word.
    """
    out = []
    for match in re.finditer(r"(.)\1*", span.lower(), re.S):
        char, size = match[1], match.end() - match.start()
        code = ord(char)
        letter = int(table[code]) if code < 1 << 16 else OTHER
        if letter != EDGE:
            sizes = [size] if size < 3 else [1, 2]
            out.append([((letter,) * n, char * n, 0.0 if n == size else REPEAT) for n in sizes])
            continue
        inside = 0 < match.start() and match.end() < len(span)
        drop = 0.0 if char in SEPARATORS else DROP_INSIDE if inside else DROP
        options = [((), "", drop), ((EDGE,), " ", SPLIT if size == 1 else 0.0)]
        for n in (1, 2) if size > 1 else (1,):
            options += [
                ((ord(x) - 96,) * n, x * n, SUBSTITUTE * n + (REPEAT if n != size else 0.0))
                for x in STANDS_FOR.get(char, "")
            ]
        out.append(options)
    return out


def restore(span: str, model: np.ndarray, table: np.ndarray) -> str:
    """The likeliest text behind ``span``: Viterbi over the last two letters."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for options in [*lattice(span, table), [((EDGE,), "", 0.0)]]:
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for letters, text, cost in options:
                x, y, total = a, b, score + cost
                for letter in letters:
                    if letter == EDGE and y == EDGE:
                        continue
                    total += float(model[x, y, letter])
                    x, y = y, letter
                if (x, y) not in following or following[x, y][0] < total:
                    following[x, y] = (total, (path, text) if text else path)
        best = following
    path = max(best.values(), key=lambda v: v[0])[1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def disguised(codes: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Spans of a text that may hide words: runs of single letters, and whole tokens with a digit
    or sign next to a letter or with a letter three times in a row."""
    if len(codes) < 3:
        return []
    letter = _letters(codes, table) != EDGE
    low = np.minimum(codes, (1 << 16) - 1)
    signs, blank, split = (np.zeros(1 << 16, bool) for _ in range(3))
    signs[[ord(c) for c in STANDS_FOR]] = True
    blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0]] = True
    split[[ord(c) for c in SEPARATORS]] = True
    sign, white, apart = signs[low], blank[low], split[low]
    marks = np.zeros(len(codes), bool)
    marks[1:] |= sign[1:] & letter[:-1]
    marks[:-1] |= sign[:-1] & letter[1:]
    triple = letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
    marks[2:] |= triple
    # Alternating letters and separators, five or more in a row.
    even = np.zeros(len(codes), bool)
    even[1:] = (letter[1:] & apart[:-1]) | (apart[1:] & letter[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], even, [False]]).astype(np.int8)))
    spans = []
    for begin, end in zip((edges[::2] - 1).tolist(), edges[1::2].tolist()):
        # Only whole letters: neither end may cut a word.
        if begin > 0 and letter[begin] and letter[begin - 1]:
            begin += 2
        if end < len(codes) and letter[end - 1] and letter[end]:
            end -= 2
        while begin < end and not letter[begin]:
            begin += 1
        while begin < end and not letter[end - 1]:
            end -= 1
        if end - begin >= 5:
            spans.append((begin, end))
    held = np.zeros(len(codes), bool)
    for begin, end in spans:
        held[begin:end] = True
    places = np.flatnonzero(marks & ~held)
    if len(places):
        gaps = np.flatnonzero(white)
        at = np.searchsorted(gaps, places)
        begins = np.where(at > 0, gaps[at - 1] + 1, 0) if len(gaps) else np.zeros(len(places), np.int64)
        ends = np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], len(codes)) if len(gaps) else np.full(len(places), len(codes))
        spans += {(int(b), int(e)) for b, e in zip(begins, ends) if not held[b:e].any()}
    return sorted(spans)


class Restorer:
    """Restored texts, spans met before looked up."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.table, self.known = model, letter_table(), {}

    def _span(self, span: str) -> str:
        found = self.known.get(span)
        if found is None:
            # Spans beyond SPAN characters are decoded piece by piece.
            found = "".join(
                restore(span[i : i + SPAN], self.model, self.table) for i in range(0, len(span), SPAN)
            )
            if len(self.known) >= KNOWN_SPANS:
                self.known.clear()
            if len(span) <= SPAN:
                self.known[span] = found
        return found

    def __call__(self, text: str) -> str:
        spans = disguised(_codes(text), self.table)
        if not spans:
            return text
        parts, end = [], 0
        for begin, stop in spans:
            parts += [text[end:begin], self._span(text[begin:stop])]
            end = stop
        return "".join([*parts, text[end:]])


# --- lexicon and score ----------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct words and word beginnings (marked by a caret) of a restored text."""
    words = set(_WORD.findall(text.lower()))
    return words.union(f"^{w[:k]}" for w in words for k in PREFIXES if len(w) > k)


def evidence(text: str, lexicon: dict[str, float]) -> tuple[float, float]:
    """Largest and summed weight of the distinct words; a word counts by itself or, unknown, by
    its longest known beginning."""
    top = total = 0.0
    for word in set(_WORD.findall(text.lower())):
        weight = lexicon.get(word)
        if weight is None:
            for k in PREFIXES:
                if len(word) > k:
                    weight = lexicon.get(f"^{word[:k]}")
                    if weight is not None:
                        break
        if weight is not None and weight > 0:
            top = max(top, weight)
            total += weight
    return top, math.log1p(total)


def held_out() -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, part): at most SAMPLE rows of each class, never one that is held out.

    A doc_id with several labels is toxic if one of them is.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    single = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    place = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    some = [single.filter(c).orderBy(place, "doc_id").limit(SAMPLE) for c in ("toxic", "not toxic")]
    return some[0].unionByName(some[1]).withColumn("part", F.pmod(place, F.lit(PARTS)).cast("int"))


def _feature_counts(model: np.ndarray, wanted: set[str] | None):
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: dict[str, int] = {}
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    found = features(restorer(text or ""))
                    for f in found if wanted is None else found & wanted:
                        counts[f] = counts.get(f, 0) + 1
        yield pa.RecordBatch.from_pydict({"feature": list(counts), "n": list(counts.values())}, schema=schema)

    return run


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon (feature to weight) and three numbers of its calibration.

    A weight is the log odds of toxicity of a feature, by a cautious estimate, minus those of the
    average. Features come from toxic texts of the sample and are counted in all its texts. The
    calibration is a logistic fit on the part of the sample that the lexicon has not seen.
    """
    sample = F.broadcast(training_labels(labels))  # 2 * SAMPLE rows of three numbers at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id")
    lexical = rows.filter(F.col("part") < PARTS - 1)

    def counted(condition: str, wanted: set[str] | None = None) -> DataFrame:
        found = lexical.filter(condition).select("text").mapInArrow(
            _feature_counts(model, wanted), "feature string, n bigint"
        )
        return found.groupBy("feature").agg(F.sum("n").alias("n"))

    best = counted("toxic").filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "feature").limit(LEXICON)
    toxic = {r.feature: r.n for r in best.collect()}
    clean = {r.feature: r.n for r in counted("not toxic", set(toxic)).collect()}
    sizes = {r.toxic: r.n for r in lexical.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return {}, np.array([-10.0, 0.0, 0.0])
    average = sizes[True] / (sizes[True] + sizes[False])
    odds = lambda p: math.log(p / (1 - p))
    lexicon = {}
    for feature, n in toxic.items():
        texts = n + clean.get(feature, 0) + PRIOR
        share = (n + PRIOR * average) / texts
        share -= CAUTION * math.sqrt(share * (1 - share) / (texts + 1))
        weight = odds(max(share, 1e-6)) - odds(average)
        if weight > LEAST_WEIGHT:
            lexicon[feature] = weight

    schema = pa.schema([("toxic", pa.bool_()), ("top", pa.float64()), ("total", pa.float64())])

    def weigh(batch):
        restorer = weigh.__dict__.setdefault("restorer", Restorer(model))
        found = [evidence(restorer(t or ""), lexicon) for t in batch.column("text").to_pylist()]
        return {"toxic": batch.column("toxic"), "top": [f[0] for f in found], "total": [f[1] for f in found]}

    seen = rows.filter(F.col("part") == PARTS - 1).select("toxic", "text")
    fit = seen.mapInArrow(by_slices(weigh, schema), "toxic boolean, top double, total double").collect()
    return lexicon, calibrate(np.array([[r.top, r.total] for r in fit]).reshape(-1, 2), np.array([r.toxic for r in fit], float))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, slopes never negative."""
    if not len(y) or y.min() == y.max():
        return np.array([-6.0, 1.5, 1.5])
    design = np.column_stack([np.ones(len(y)), x])
    coefficient = np.zeros(3)
    shrink = ridge * np.array([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coefficient, -30, 30)))
        slope = design.T @ (y - p) - shrink * coefficient
        bend = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3)
        step = np.linalg.solve(bend, slope)
        coefficient += step
        if np.abs(step).max() < 1e-8:
            break
    coefficient[1:] = np.maximum(coefficient[1:], 0)
    return coefficient


def score_toxicity(docs: DataFrame, labels: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; ``restored`` if asked for.

    Letter trigrams are counted over all texts. Characters that may disguise a word (digits and
    signs for letters, letters spaced out or repeated) form a lattice of readings; the likeliest
    under the trigrams is put in their place, and the words of the restored text are weighed by
    a lexicon learned from ``labels`` (doc_id, toxic) outside the held-out third.

    Null and empty texts have no evidence and the lowest score. A null doc_id is not held out and
    never learned from. Repeated rows get the same score. Without labels of both classes all
    scores are near 0. Long texts are scored whole. An empty table gives an empty result, other
    columns are not looked at.
    """
    model = language_model(trigram_counts(docs))
    lexicon, coefficient = learn(docs, labels, model)
    names = ["doc_id", "held_out", "score", "predicted"] + ["restored"] * with_text
    kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.int32()] + [pa.string()] * with_text
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [restorer(t or "") for t in part.column("text").to_pylist()]
                found = np.array([evidence(t, lexicon) for t in texts]).reshape(-1, 2)
                score = 1 / (1 + np.exp(-np.clip(coefficient[0] + found @ coefficient[1:], -30, 30)))
                columns = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ] + [pa.array(texts)] * with_text
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(
        run,
        "doc_id bigint, held_out boolean, score double, predicted int" + ", restored string" * with_text,
    )
