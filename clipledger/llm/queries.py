"""The named queries of these operators and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import (
    alignment,
    crosspolytope,
    linechunks,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    suffixes,
    toxicity,
    warczip,
    wordruns,
)
from clipledger.llm.common import table
from clipledger.session import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids_crc32 is taken from the ids where they are packed, so they travel as in the pipeline.
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY).drop("ids")


WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '{WORDS}') ws from d),
l as (select r, source, t, unnest(string_split(t, chr(10))) line,
    generate_subscripts(string_split(t, chr(10)), 1) i from w),
n as (select *, translate(array_to_string(regexp_extract_all(line, '{WORDS}'), ' '), '{UPPER}', '{LOWER}') key,
    len(regexp_extract_all(line, '{WORDS}')) words from l),
f as (select source, key, count(distinct t) times from n where words between 1 and {quality.MAX_LINE_WORDS}
    group by source, key),
h as (select source, count(distinct t) docs from d group by source),
frequent as (select f.source, f.key from f join h on f.source is not distinct from h.source
    where times > {quality.MAX_DOCUMENTS} and times > docs * {quality.MAX_SHARE}),
lost as (select n.r, sum(n.words) lost from n join frequent q
    on n.key = q.key and n.source is not distinct from q.source where n.words > 0 group by n.r),
dup as (select r, sum(c - 1) dups from (select r, line, count(*) c from n where words > 0 group by r, line) group by r),
g as (select r, unnest(range(1, len(ws) - 1)) p, ws from w where len(ws) >= 3),
k as (select r, p, struct_pack(a := ws[p], b := ws[p + 1], c := ws[p + 2]) s from g),
twice as (select r, p from (select r, p, count(*) over (partition by r, s) c from k) where c > 1),
rep as (select r, count(distinct p + o) reps from twice, (values (0), (1), (2)) v(o) group by r),
b as (select w.r, doc_id, cast(len(ws) as bigint) n_words,
    cast(length(array_to_string(ws, '')) as bigint) word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols,
    cast(coalesce(dups, 0) as bigint) n_dup_lines, cast(coalesce(reps, 0) as bigint) n_repeat_words,
    cast(len(ws) - coalesce(lost, 0) as bigint) n_kept_words
    from w left join dup using (r) left join rep using (r) left join lost using (r)),
e as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words
    base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, base_failed,
    not base_failed and n_kept_words >= n_words * {quality.MIN_LEFT} kept from e
"""


@query("op2_quality_rules", QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# crc32 by bytes: the table of 256 steps is made by eight halvings with the reversed polynomial.
SHARDING = rf"""
with recursive halved(n, c, k) as (
    select i, i, 0 from range(256) t(i) union all
    select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from halved where k < 8),
steps as materialized (select list(c order by n) s from halved where k = 8),
d as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 size, encode(coalesce(text, '')) raw,
    md5(concat_ws(':', '{sharding.SEED}', coalesce(doc_id::varchar, ''))) mix from documents),
x as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(hex(raw), 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, s[xor(a & 255, b) + 1]))) text_crc32 from d, steps),
r as (select *, (row_number() over (partition by source order by mix, doc_id, text_crc32, size) - 0.5::double)
    / count(*) over (partition by source) share from x),
p as (select *, row_number() over (order by share, source is null, coalesce(source, ''), mix, doc_id, text_crc32, size)
    - 1 pos, count(*) over () total from r),
s as (select *, pos * {sharding.SHARDS} // total shard from p)
select doc_id, cast(size as bigint) size, text_crc32, 'rows' law, cast(shard as int) shard,
    pos - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} slot, cast(null as int) grown_shard from s
"""


@query("op4_sharding", SHARDING)
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


EMBEDDINGS = f"""
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
    and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) size from v),
k as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
    and a.size > 0 and b.size > 0 and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / a.size / b.size >= {crosspolytope.THRESHOLD}),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, k.b from reach join k on reach.b = k.a),
c as (select a vec_id, min(b) component_id from reach group by a),
n as (select a vec_id, count(*) n_links from k group by a)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept
from c left join n using (vec_id)
"""


@query("op5_embedding_near_dedup", EMBEDDINGS)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


SUBSTRING = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - {substring.WINDOW - 2})) p, ws from w where len(ws) >= {substring.WINDOW}),
k as (select doc_id, p, array_to_string(ws[p : p + {substring.WINDOW - 1}], ' ') key from s),
m as (select doc_id, p, min(doc_id) over (partition by key) low from k),
g as (select distinct doc_id, p + o q from m, range({substring.WINDOW}) t(o) where low < doc_id),
a as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) q from w),
left_over as (select a.doc_id, string_agg(word, ' ' order by q) kept, count(*) n
    from a anti join g on a.doc_id = g.doc_id and a.q = g.q group by a.doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed,
    sha256(coalesce(kept, '')) kept_sha256 from w left join left_over using (doc_id)
"""


@query("op6_substring_dedup", SUBSTRING)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


_LINE_HASH = f"('0x' || substr(md5(line), 1, {linechunks.LINE_HASH_DIGITS}))::bigint"

LINES = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line,
    generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
h as (select *, {_LINE_HASH} h from l),
e as (select *, coalesce((lag(h) over o * {linechunks.ROLL} + h) % {linechunks.DIVISOR} = 0, false) ends from h
    window o as (partition by doc_id order by i)),
c as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i
    rows between unbounded preceding and 1 preceding), 0) idx from e),
b as (select doc_id, idx, string_agg(line, chr(10) order by i) body, count(*) n,
    count(*) filter (regexp_matches(line, '[^\x20\x09-\x0D]')) full_lines from c group by doc_id, idx),
r as (select *, n >= {linechunks.MIN_LINES} and full_lines >= 2 and row_number() over (
    partition by body, n >= {linechunks.MIN_LINES} order by doc_id, idx) > 1 gone from b),
t as (select doc_id, sum(n) n_lines, count(*) n_chunks, sum(case when gone then n else 0 end) n_removed_lines,
    coalesce(string_agg(body, chr(10) order by idx) filter (not gone), '') kept from r group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_chunks, 0) as bigint) n_chunks,
    cast(coalesce(n_removed_lines, 0) as bigint) n_removed_lines, sha256(kept) kept_sha256
from documents d left join t using (doc_id)
"""


@query("op7_line_dedup", LINES)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linechunks.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


WARC = f"""
with p as (select page_id, encode(coalesce(html, '')) raw from pages),
d as (select page_id, octet_length(raw) n, sha256(raw) digest, min(page_id) over (partition by raw) low from p)
select page_id, cast(n as bigint) payload_bytes, digest payload_digest,
    case when n >= {warczip.MIN_REVISIT} and low <> page_id then 'revisit' else 'response' end record_type,
    case when n >= {warczip.MIN_REVISIT} and low <> page_id then low end refers_to from d
"""


@query("op9_zip_warc", WARC)
def zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warczip.archive_pages(spark, table(spark, sf_dir, "pages"))
    return warczip.read_archives(archives, payload=False).drop("url", "payload")


def _unit(*parts: str) -> str:
    key = f"md5(concat_ws(':', '{mixing.SEED}', {', '.join(parts)}))"
    return f"('0x' || substr({key}, 1, {mixing.UNIT_DIGITS}))::bigint::double / {1 << 4 * mixing.UNIT_DIGITS}"


MIXING = f"""
with s as (select source, count(*) n, cast(pow(count(*)::double, {mixing.TEMPERATURE}) as decimal(30,9)) w
    from documents group by source),
z as (select *, (sum(n) over ())::double * w::double / (sum(w) over ())::double / n rate from s),
q as (select source, rate, greatest(1, ceil(rate / {mixing.MEAN_STEP}))::int steps from z),
k as (select source, i, exp(-rate / steps) * pow(rate / steps, i) / gamma(i + 1) p
    from q, range({mixing.TERMS}) t(i)),
c as (select source, i, sum(p) over (partition by source order by i) cdf from k),
u as (select row_number() over () r, d.doc_id, d.source, q.rate, q.steps from documents d
    join q on d.source is not distinct from q.source),
v as (select *, unnest(range(1, steps + 1)) step from u),
o as (select r, doc_id, source, rate, {_unit("step", "coalesce(doc_id::varchar, '')")} x from v),
m as (select o.r, doc_id, o.source, rate, count(*) filter (cdf <= x) times from o join c
    on o.source is not distinct from c.source group by all),
f as (select r, doc_id, source, rate, sum(times) times from (select * from m) group by all),
e as (select doc_id, source, rate, unnest(range(times::bigint)) copy from f)
select doc_id, source, rate, cast(copy as int) copy,
    md5(concat_ws(':', '{mixing.SEED}', 'order', copy, coalesce(doc_id::varchar, ''))) shuffle_key from e
"""


@query("op10_mixing", MIXING)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole documents are repeated, shuffled and written; the columns of the twin are read back.
    documents = store(mixing.replicate(table(spark, sf_dir, "documents")), "mixed")
    return documents.select("doc_id", "source", "rate", "copy", "shuffle_key")


_N = suffixes.WINDOW

SUFFIXES = f"""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) hx from documents),
s as (select r, doc_id, hx, unnest(range(length(hx) // 2 - {_N - 1})) p from d where length(hx) >= {2 * _N}),
k as (select r, doc_id, p, substr(hx, 2 * p + 1, {2 * _N}) piece from s),
m as (select r, doc_id, p, min(doc_id) over (partition by piece) low from k),
g as (select r, p, p - lag(p) over (partition by r order by p) step from m where low < doc_id),
i as (select r, p, sum(case when step <= {_N} then 0 else 1 end) over (partition by r order by p) island from g),
t as (select r, min(p) b, max(p) + {_N} e from i group by r, island),
u as (select r, b, e, lag(e, 1, 0) over (partition by r order by b) before from t),
kept as (select r, string_agg(substr(hx, 2 * before + 1, 2 * (b - before)), '' order by b) head,
    max(e) e, sum(e - b) n, count(*) spans from u join d using (r) group by r)
select doc_id, cast(length(hx) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed,
    cast(coalesce(spans, 0) as bigint) n_spans,
    sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(e, 0) + 1))) kept_sha256
from d left join kept using (r)
"""


@query("op11_suffix_dedup", SUFFIXES)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by its checksum repeats some of its words to its end."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                h = zlib.crc32(str(doc).encode()) if doc is not None else 1
                if h % 10 == 0 and texts[i]:
                    words = texts[i].encode().split()
                    n, g = len(words), h // 10
                    if n:
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
                        texts[i] = b" ".join(words).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text string")


RUNS = rf"""
with recursive halved(n, c, k) as (
    select i, i, 0 from range(256) t(i) union all
    select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from halved where k < 8),
steps as materialized (select list(c order by n) s from halved where k = 8),
d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') ws from documents),
c as (select d.*, len(ws) n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint)),
    lambda a, b: xor(a >> 8, s[xor(a & 255, b) + 1]))) h from d, steps),
p as (select r, doc_id, ws, n, n > 0 and h % 10 = 0 planted, case when n > 0 then h // 10 % n end a,
    case when n > 0 then 1 + (n - h // 10 % n) // (3 + h // 10 % 8) end p from c),
i as (select *, unnest(range(n)) i from p),
w as materialized (select r, i, case when planted and i >= a then ws[a + (i - a) % p + 1] else ws[i + 1] end word from i),
m as (select x.r, x.i, y.i - x.i q from w x join w y on x.r = y.r and x.word = y.word and y.i > x.i),
s as (select r, q, i, i - row_number() over (partition by r, q order by i) k from m),
t as (select r, q, min(i) start, count(*) + q length from s group by r, q, k
    having count(*) >= q and count(*) + q >= {wordruns.LEAST}),
u as materialized (select r, start, length, min(q) q from t group by r, start, length),
best as (select r, count(*) n_runs, arg_max(struct_pack(s := start, l := length, q := q), [length, -start, -q]) b,
    string_agg(concat(start, ',', length, ',', q, chr(10)), '' order by start, q) shown from u group by r),
kept as (select w.r, string_agg(word, ' ' order by w.i) text from w anti join u
    on w.r = u.r and w.i >= u.start + u.q and w.i < u.start + u.length group by w.r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(b.s as bigint) start, cast(b.l as bigint) length,
    cast(b.q as bigint) period, cast(1000 * b.l // b.q as bigint) exponent_milli,
    sha256(coalesce(shown, '')) runs_sha256, sha256(coalesce(kept.text, '')) collapsed_sha256
from p left join best using (r) left join kept using (r)
"""


@query("op12_word_runs", RUNS)
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wordruns.word_runs(_planted(table(spark, sf_dir, "documents")))
    # The greatest length, then the smallest start and period.
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    )
    shown = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.q")).alias("period"),
        F.expr("1000 * _best.l div -_best.q").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(shown, lambda r: F.concat(r, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)
