"""The corpus pipeline against a run of its stages by brute force."""

import collections
import re

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.test_operators import (
    DOCS,
    brute_base,
    brute_chunks,
    brute_classes,
    check_packed,
    odd_rows,
)

from clipledger.llm import mixing, quality


def brute_kept(rows):
    """(doc_id, text, source) of kept documents, without their frequent lines."""
    norm = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).translate(
        {c: c + 32 for c in range(65, 91)}
    )
    texts, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text)
        for line in (text or "").split("\n"):
            if 0 < len(norm(line).split(" ")) <= quality.MAX_LINE_WORDS and norm(line):
                texts[source, norm(line)].add(text)
    often = {
        k for k, v in texts.items()
        if len(v) > quality.MAX_DOCUMENTS and len(v) > quality.MAX_SHARE * len(hosts[k[0]])
    }
    out = []
    for doc, text, source in rows:
        words, _, _, _, repeated = brute_base(text)
        lines = [x for x in (text or "").split("\n") if (source, norm(x)) not in often]
        left = sum(brute_base(x)[0] for x in lines)
        if words >= 50 and 100 * repeated <= 50 * words and left >= words * quality.MIN_LEFT:
            out.append((doc, "\n".join(lines), source))
    return out


def test_pipeline(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    kept = brute_kept(rows)
    cut = brute_chunks([r[:2] for r in kept])
    chunked = [(i, cut[i], s) for i, _, s in kept if re.search(r"[^\x20\x09-\x0D]", cut[i])]
    alone = {i for i, _, c in brute_classes([r[:2] for r in chunked]) if i == c}
    single = [r for r in chunked if r[0] in alone]
    docs = spark.createDataFrame([(i, t, "", s, 0) for i, t, s in single], DOCS)
    mixed = [(r.doc_id, r.text) for r in mixing.replicate(docs).collect()]
    found = entry.queries()["pipeline"](spark, sf_dir).collect()
    check_packed(found, mixed)


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("hits", docs.doc_id), sf_dir)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
