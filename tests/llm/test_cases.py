"""Long texts and clashing names for the operators that other tests give none, and the queries over a whole small table
against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small_tables import LONG, docs_of, judged_plainly, rows_of

import corpus_pipeline
from millstone.llm import chat, packing, sharding, shingles, tokens, toxicity, urls, warc
from millstone.llm.queries import QUERIES, URL_RULES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
#: Names that operators give to columns of their own.
CLASHING = [
    "key",
    "copy",
    "length",
    "n",
    "h1",
    "h2",
    "node",
    "root",
    "task",
    "score",
    "y",
    "shard",
    "slot",
    "rank",
    "bucket",
    "size",
    "stratum",
    "start",
    "seq",
    "part",
    "held_out",
    "predicted",
    "component_id",
    "n_links",
    "items",
    "pack",
    "bin",
    "at",
    "might",
    "listed",
    "maybe",
    "kept",
    "digest",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = docs_of(
        spark,
        [(i, f"word{i % 7} and some more words of text {i % 3}" if i % 5 else None, f"s{i % 3}") for i in range(40)],
    )
    return rows, rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def test_clashing_columns_change_nothing(spark, clashing):
    plain, more = clashing
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def ids(df):
        return rows_of(tokens.read_shards(tokens.write_shards(df, tokenizer_path())))

    def scores(df):
        return rows_of(toxicity.score(df, toxicity.train(df, labels)))

    for f in (
        lambda df: rows_of(packing.packed(packing.byte_lengths(df))),
        lambda df: rows_of(packing.read_pieces(packing.write_sequences(df))),
        ids,
        lambda df: rows_of(sharding.interleaved(df)),
        lambda df: rows_of(shingles.linked_components(df, count=True)),
        scores,
    ):
        assert f(plain) == f(more)


def test_clashing_columns_pass_the_stages(spark, clashing):
    plain, more = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, more, SMALL)
        assert kept.columns == more.columns, name
        assert rows_of(kept.select(*plain.columns)) == rows_of(stage(spark, plain, SMALL)), name
    assert rows_of(corpus_pipeline.into_bins(spark, more, SMALL)) == rows_of(
        corpus_pipeline.into_bins(spark, plain, SMALL)
    )


def test_nulls_pass_the_stages(spark):
    rows = docs_of(
        spark,
        [
            (1, None, None),
            (1, None, None),
            (2, "", "a"),
            (None, "text of its own", None),
            (None, None, "b"),
            (3, " ", "a"),
        ],
    )
    now = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL).cache()
    assert Counter(map(tuple, now.collect())) == Counter(set(map(tuple, rows.collect())))
    assert sorted(r.n for r in corpus_pipeline.into_bins(spark, now, SMALL).collect()) == sorted(
        len((r.text or "").encode()) + 1 for r in now.collect()
    )


def test_long_texts(spark):
    long = LONG * 3
    page = spark.createDataFrame(
        [(1, "http://a.org/" + "x/" * 20_000, long), (2, None, long)], "page_id long, url string, html string"
    )
    got = {r.page_id: r for r in warc.read_records(warc.write_archives(warc.labelled(page))).collect()}
    assert got[2].payload.decode() == long and got[1].refers_to == 2 and got[1].payload_bytes == len(long) and got[1].url == "http://a.org/" + "x/" * 20_000
    turns = spark.createDataFrame(
        [(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"
    )
    r = chat.read_back(chat.assembled(chat.format_turns(turns))).first()
    assert (r.loss_chars, r.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    deep = "http://" + "a." * 300 + "example.org/es/" + "p" * 50_000
    pages = spark.createDataFrame([(1, deep)], "page_id long, url string")
    assert tuple(urls.judged(pages, rules).select("host", "path", "rule", "verdict").first()) == judged_plainly(
        deep, set()
    )


def test_op1_query_holds_every_text(spark, docs):
    got = Counter((r.doc_id, r.start, r.n, r.tokens_crc32) for r in QUERIES["op1_packing"](spark, SMALL).collect())
    want = Counter()
    for r in docs.collect():
        own = bytes([*(r.text or "").encode(), packing.END])
        for start in range(0, len(own), 32768):
            want[r.doc_id, start, len(own[start : start + 32768]), zlib.crc32(own[start : start + 32768])] += 1
    assert got == want


def test_op4_query_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    at, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op4_token_shards"](spark, SMALL).collect())) == want


def test_shards_keep_to_their_size(spark, docs):
    manifest = tokens.write_shards(docs, tokenizer_path(), shard_tokens=20_000).orderBy("start").collect()
    most = max(len(r.text or "") for r in docs.collect())
    assert all(r.tokens >= 20_000 for r in manifest if (r.part, r.seq + 1) in {(x.part, x.seq) for x in manifest})
    assert all(r.tokens < 20_000 + most + 1 for r in manifest)
    ends = np.cumsum([r.tokens for r in manifest])
    assert [r.start for r in manifest] == [0, *ends[:-1].tolist()]


def test_op6_query_equals_a_plain_sort(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_sharding"](spark, SMALL).collect()}
    rows = docs.withColumn(
        "key",
        F.xxhash64(
            "doc_id",
            (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")),
            F.lit(42),
            F.lit(0).cast("long"),
        ),
    ).collect()
    by_source: dict = {}
    for r in sorted(rows, key=lambda r: r.key % (1 << 64)):
        by_source.setdefault(r.source, []).append(r)
    ranked = sorted(
        ((i + 0.5) / len(own), r.key, r.source or "", r.doc_id)
        for own in by_source.values()
        for i, r in enumerate(own)
    )
    n = len(rows)
    for rank, (_, _, _, doc) in enumerate(ranked):
        shard = rank * 16 // n
        r = got[doc]
        assert (r.shard, r.slot) == (shard, rank - -(-shard * n // 16))
    for r in rows:
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law, got[r.doc_id].grown_shard) == (
            len(raw) + 1, zlib.crc32(raw), "rows", None
        )


def test_op8_query_finds_held_out_toxic_documents(spark):
    """Quality on the labels that are never learnt from, at the largest scale of labels."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [
        (r.score, r.predicted, labels[r.doc_id])
        for r in QUERIES["op8_toxicity"](spark, folder).where("held_out").collect()
        if r.doc_id in labels
    ]
    score, predicted, toxic = (np.array(x) for x in zip(*rows, strict=True))
    place = np.empty(len(score))
    place[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    n = int(toxic.sum())
    auc = (place[toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(toxic) - n))
    assert n > 80 and auc > 0.96 and predicted[toxic == 1].mean() > 0.88 and predicted[toxic == 0].mean() < 0.02


def test_run_equals_brute_force(spark, docs):
    """``run`` as a whole: plain scores, components, hits and packing, one after another."""
    import pyarrow as pa
    from test_small_tables import plain_components, plain_hits, plain_sets

    from millstone.llm.words import ALNUM, words_of

    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [
        (r.doc_id, r.text)
        for r in docs.collect()
        if float(model.scores(next(words_of(pa.array([r.text or ""]), ALNUM)))[0]) < 0.3
    ]
    component = plain_components([i for i, _ in rows], plain_sets([t for _, t in rows]))
    rows = [r for r, c in zip(rows, component, strict=True) if c == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    sizes = {}
    for i, text in rows:
        n_words, n_hit, _, _, bad = plain_hits(text, items)
        if not bad and not n_hit:
            sizes[i] = len((text or "").encode()) + 1
        elif not bad:
            sizes[i] = None
    out = corpus_pipeline.run(spark, SMALL).collect()
    got: dict = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert set(got) == set(sizes)
    texts = dict(rows)
    for i, n in got.items():
        # Of texts that lose a passage the rest stays: shorter, and without the words that were hit.
        assert n == sizes[i] if sizes[i] is not None else 1 < n < len(texts[i].encode()) + 1
    order = sorted((n, i) for i, n in got.items())
    pieces = [(i, a, min(n - a, 32768)) for n, i in order for a in range(0, n, 32768)]
    plain = packing.best_fit(np.array([n for _, _, n in pieces]))
    want = {
        (i, a, n, int(b), int(at), int(plain.length[b]))
        for (i, a, n), b, at in zip(pieces, plain.bin, plain.at, strict=True)
    }
    assert {(r.doc_id, r.start, r.n, r.bin, r.at, r.bin_length) for r in out} == want

