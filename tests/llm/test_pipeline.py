"""The pipeline at the smallest scale, against plain readings of each stage's contract."""

from __future__ import annotations

import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from millstone.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_hand_on_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    now = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL).cache()
        assert now.columns == names
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    packed = corpus_pipeline.into_bins(spark, now, SMALL).collect()
    want = {r.doc_id: len((r.text or "").encode()) + 1 for r in now.collect()}
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == want


def test_decisions_equal_brute_force(spark):
    """Each stage on its own input: scores by the model one by one, components and hits by plain loops."""
    from test_small_tables import plain_components, plain_hits, plain_sets

    from millstone.llm import toxicity
    from millstone.llm.words import ALNUM, words_of

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    clean = corpus_pipeline.toxic_out(spark, docs, SMALL).collect()
    score = {r.doc_id: float(model.scores(next(words_of(pa.array([r.text or ""]), ALNUM)))[0]) for r in docs.collect()}
    assert sorted(clean) == sorted(r for r in docs.collect() if score[r.doc_id] < 0.3)

    rest = spark.createDataFrame(clean, docs.schema)
    ids = [r.doc_id for r in clean]
    component = plain_components(ids, plain_sets([r.text for r in clean]))
    single = corpus_pipeline.one_of_each(spark, rest, SMALL).collect()
    assert sorted(r.doc_id for r in single) == sorted(
        {min(c, i) for i, c in zip(ids, component, strict=True) if c == i}
    )

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = {r.doc_id: plain_hits(r.text, items) for r in single}
    kept = {
        r.doc_id: r
        for r in corpus_pipeline.benchmark_out(spark, spark.createDataFrame(single, docs.schema), SMALL).collect()
    }
    assert set(kept) == {i for i, h in hits.items() if not h[-1]}
    for i, r in kept.items():
        n_words, n_hit = hits[i][:2]
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")) == n_words - n_hit


def test_repeated_rows_are_one_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "a text without an id", "en", "s", 20)] * 2 + [(9999, None, None, None, None)] * 2, docs.schema
    )
    once = corpus_pipeline.one_of_each(spark, docs, SMALL)
    twice = corpus_pipeline.one_of_each(spark, docs.unionAll(docs).unionAll(odd), SMALL)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.unionAll(odd.distinct()).collect()))


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [
        (5, a),
        (5, b),
        (3, a),
        (7, c),
        (7, c + " more"),
        (None, d),
        (None, d + " more"),
        (None, b + " more"),
        (8, None),
        (8, ""),
        (None, None),
        (None, ""),
    ]
    given = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, given.repartition(3), SMALL).collect()]
    assert {(3, a), (5, b), (8, None), (8, ""), (None, None), (None, "")} < set(kept)
    assert sorted((str(i), (t or "")[:1]) for i, t in kept) == sorted(
        [("3", "a"), ("5", "b"), ("7", "c"), ("None", "d"), ("8", ""), ("8", ""), ("None", ""), ("None", "")]
    )


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
