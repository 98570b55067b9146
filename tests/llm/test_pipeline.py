"""The pipeline against a version in plain Python, and its registration."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from test_decontaminate import brute
from test_dedup import bits, lower, plain_fingerprint, roots

from barlens.llm import bpe, quality
from barlens.llm.queries import ORACLES, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and set(QUERIES) <= set(e.queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, sf):
    docs, labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    forest = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    x = np.array([quality.statistics(t) for _, t in rows])
    rows = [r for r, s in zip(rows, forest.scores(x), strict=True) if s >= 0.3]
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), i), i)
    rows = [(i, t) for i, t in rows if best[lower(t)] == i]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    distinct = sorted(set(prints.values()))
    root = {f: f for f in distinct} | roots([(a, b) for a in distinct for b in distinct if a < b and bits(a, b) <= 3])
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(least.get(root[f], i), i)
    rows = [(i, t) for i, t in rows if least[root[prints[i]]] == i]
    leaked = {d for d, *_ in brute(rows, [(r.item_id, r.text) for r in benchmark.collect()])}
    rows = [(i, t) for i, t in rows if i not in leaked]
    coder = bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = set()
    for i, t in rows:
        ids = coder.encode_packed(t or "")
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) and leaked


def test_stages_take_odd_rows(spark, sf, odd):
    frame = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count()


def test_registered_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLES.items():
        frame = QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        rel = con.sql(sql)
        order = [rel.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[i] for i in order]) for r in rel.fetchall()), name
