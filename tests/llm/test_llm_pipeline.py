"""The pipeline and the registered queries of the operators."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_leaks

import corpus_pipeline
from llm import packing, quality
from llm.common import read, remainder, written
from llm.queries import oracle_sql, queries

TABLES = ["documents", "embeddings", "labels", "benchmark"]
SMALL = ["op3_mixing", "op5_line_templates", "op7_ngram_join", "op9_decontamination", "op11_warc", "op12_lexical_search"]


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """How often each (doc_id, source, text) is taken."""
    size = {k: len(re.findall("[^\\x20\\x09-\\x0D]+", text)) for k, (_, text) in rows.items()}
    total = Counter()
    for k, (source, _) in rows.items():
        total[source] += size[k]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(total))}
    full = set()
    while True:
        unit = (share * sum(total.values()) - most * sum(total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s, w in weight.items() if unit * w > most * total[s]}
        if over == full:
            break
        full = over
    taken = {}
    for s in total:
        rate = min(most * total[s], unit * weight[s]) / total[s]
        shift = int(hashlib.md5(f"mix:{s}".encode()).hexdigest()[:8], 16) / 2**32
        for rank, k in enumerate(sorted((k for k in rows if rows[k][0] == s), key=lambda k: (-size[k], k)), 1):
            taken[k] = math.floor(rate * rank + shift) - math.floor(rate * (rank - 1) + shift)
    return {k: n for k, n in taken.items() if n}


def test_stages_filter_what_they_are_for(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    bench = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), f"test-{name}")
        if name == "packing":
            coder, found = packing.encoder(open(packing.VOCABULARY, "rb").read()), Counter()
            for r in after.collect():
                for doc, a, b in zip(r.doc_ids, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                    found[doc] += b - a
            assert found == {d: times[d] * (len(coder.encode_ordinary(x)) + 1) for d, x in before.items()}
            break
        assert after.columns == docs.columns
        now = {r.doc_id: r.text for r in after.collect()}
        assert all(before[k] == t for k, t in now.items())
        times = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name == "quality":
            model = quality.learn(docs, read(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 4) != 2)
            assert set(now) == {r.doc_id for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD}
        if name == "mixing":
            assert times == brute_mix({k: (source[k], x) for k, x in before.items()})
        if name == "near_duplicates":
            assert set(now) == {n for n, _, c in brute_components([*before.items()]) if n == c}
        if name == "decontamination":
            assert set(now) == {n for n, _, h, _ in brute_leaks([*before.items()], bench) if h == 0}
        docs, before = after, now


@pytest.mark.parametrize("name", SMALL if not os.environ.get("CHECK_ALL") else sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    for table in ("embeddings",):
        duck.sql(f"CREATE VIEW IF NOT EXISTS {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found, expected = queries()[name](spark, sf_dir), duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    rows = lambda data, names: sorted(repr([v for _, v in sorted(zip(names, row, strict=True))]) for row in data)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(expected.fetchall(), expected.columns), columns


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries()
