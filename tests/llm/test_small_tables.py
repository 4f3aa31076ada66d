"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, by operator, against brute
force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millstone.llm import chat, decontam, embeddings, packing, sharding, shingles, tokens, toxicity, urls, warc
from millstone.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty texts, copies, ties, a very long text and repeated rows."""
    base = " ".join(f"tok{i}" for i in range(60))
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base + " more", "b"), (4, None, "a"), (5, "", None), (
            6, "   \n\t", "a"
        ),
        (7, "one two", "c"), (8, "One  TWO", "c"), (9, LONG, "a"), (10, LONG + " tail", "a"), (
            None, "null id text here now please", "b"
        ), (11, "É é ß 你好 \u00a0 x", "b"), (12, "!<|endoftext|>!", "b"),
    ]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- packing ---------------------------------------------------------------------------


def test_best_fit_places_every_piece_once_within_its_bin():
    rng = np.random.default_rng(0)
    for lengths in ((16, 64, 256), (100,), (7, 13)):
        sizes = rng.integers(0, max(lengths) + 1, 500)
        got = packing.best_fit(sizes, lengths)
        for b in range(len(got.used)):
            own = np.flatnonzero(got.bin == b)
            spans = sorted((int(got.at[i]), int(sizes[i])) for i in own)
            assert sum(n for _, n in spans) == got.used[b] <= got.length[b]
            assert got.length[b] == min(c for c in lengths if c >= got.used[b])
            at = 0
            for a, n in spans:
                assert a == at
                at += n
        assert sizes.sum() / got.length.sum() > 0.9


def test_best_fit_chooses_the_tightest_open_bin_and_downsizes():
    # 60 opens a bin that 40 fills; 50 the next one, which 30 and 9 go to.
    got = packing.best_fit(np.array([60, 50, 30, 40, 9]), (32, 100), packing.Cost(overhead=0, width=10**9))
    assert got.bin.tolist() == [0, 1, 1, 0, 1] and got.used.tolist() == [100, 89] and got.at.tolist() == [
        0, 0, 50, 60, 80
    ]
    alone = packing.best_fit(np.array([10]), (16, 64))
    assert alone.length.tolist() == [16]


def test_the_length_opened_depends_on_what_is_left():
    # A long bin costs less a token when it is full, and only then.
    cost = packing.Cost(overhead=10, width=10**9)
    assert packing.best_fit(np.array([8] * 8), (8, 64), cost).length.tolist() == [64]
    assert packing.best_fit(np.array([8, 8]), (8, 64), cost).length.tolist() == [8, 8]
    assert sorted(packing.best_fit(np.array([8] * 10), (8, 64), cost).length.tolist()) == [8, 8, 64]


def least_cost(sizes, lengths, cost):
    """The cost of the best of all packings."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(cost.of(min(c for c in lengths if c >= b)) for b in bins))
            return
        for b in {b: k for k, b in enumerate(bins)}.values():
            if bins[b] + sizes[i] <= max(lengths):
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_best_fit_against_all_packings():
    rng = np.random.default_rng(3)
    ratios = []
    for _ in range(120):
        sizes = rng.integers(1, 33, int(rng.integers(1, 8)))
        cost = packing.Cost(overhead=float(rng.choice([0, 1, 6])), width=int(rng.choice([2, 5, 100])))
        got = packing.best_fit(sizes, (8, 16, 32), cost)
        ratios.append(sum(cost.of(c) for c in got.length.tolist()) / least_cost(sizes.tolist(), (8, 16, 32), cost))
    assert min(ratios) > 1 - 1e-9 and np.mean(ratios) < 1.01 and np.mean(np.array(ratios) < 1 + 1e-9) > 0.9


def test_three_lengths_cost_less_than_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    cost = packing.Cost()

    def total(lengths):
        got = packing.packed(packing.byte_lengths(docs), lengths=lengths).select(
            "pack", "bin", "bin_length"
        ).distinct().collect()
        return sum(cost.of(r.bin_length) for r in got), {r.bin_length for r in got}

    whole, used = total(packing.LENGTHS)
    assert used == set(packing.LENGTHS)
    assert all(whole < total(two)[0] for two in ((2048, 8192 * 4), (8192, 32768)))


def test_sequences_hold_every_text(spark, odd, none):
    from pyspark.sql import functions as F

    clashing = odd.withColumns({"length": F.lit(3), "raw": F.lit("r"), "pack": F.lit(1)})
    written = packing.write_sequences(clashing, lengths=(64, 512), pack_bytes=5000)
    want = Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    found: dict = defaultdict(dict)
    for r in written.collect():
        assert len(r.tokens) == r.bin_used <= r.bin_length == (64 if r.bin_used <= 64 else 512)
        for at, start, n, copy, doc in zip(r.at, r.start, r.n, r.copy, r.doc_id, strict=True):
            found[doc, copy].setdefault(start, []).append(r.tokens[at : at + n])
    pieces = Counter()
    for r in packing.read_pieces(written).collect():
        pieces[r.doc_id, r.copy, r.start, r.n, r.tokens_crc32] += 1
    ids = {}
    for (doc, raw), copies in want.items():
        tokens_ = bytes([*raw, packing.END])
        for copy in range(copies):
            for start in range(0, len(tokens_), 512):
                own = tokens_[start : start + 512]
                key = (doc, copy, start, len(own), zlib.crc32(own))
                ids[key] = ids.get(key, 0) + 1
    assert pieces == ids
    assert packing.read_pieces(packing.write_sequences(none)).count() == 0


def test_packed_keeps_every_token(spark, odd, none):
    lengths = packing.byte_lengths(odd)
    out = packing.packed(lengths, lengths=(64, 512), pack_rows=4).collect()
    want = Counter((r.doc_id, r.length) for r in lengths.collect())
    got: dict = defaultdict(list)
    bins: dict = defaultdict(list)
    for r in out:
        got[r.doc_id, r.copy, ].append((r.start, r.n))
        bins[r.pack, r.bin].append(r)
    whole = Counter()
    for (doc, _), spans in got.items():
        spans.sort()
        ends = [a + n for a, n in spans]
        assert [a for a, _ in spans] == [0, *ends[:-1]]
        whole[doc, ends[-1]] += 1
    assert whole == want
    for own in bins.values():
        own.sort(key=lambda r: (r.at, r.n))
        assert sum(r.n for r in own) == own[0].bin_used <= own[0].bin_length
        assert own[0].bin_length == (64 if own[0].bin_used <= 64 else 512)
    assert packing.packed(packing.byte_lengths(none)).count() == 0
    with pytest.raises(Exception, match="negative"):
        packing.packed(spark.createDataFrame([(1, -2)], "doc_id long, length long")).collect()


# --- WARC ------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "x" * 1500, "é" * 700
    pages = [
        (1, "http://a/ b\r\n", big),
        (2, None, big),
        (3, "u", None),
        (4, "u", ""),
        (5, "u", other),
        (9, "v", big),
        (6, "u", "small"),
        (7, "u", "small"),
        (None, "n", big),
        (8, "w", "a\r\n\r\nb" * 400),
        (9, "v", big),
    ]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    index = warc.write_archives(warc.labelled(df), file_bytes=2000)
    back = warc.read_records(index).collect()
    got = Counter(
        (
            r.page_id,
            r.payload_bytes,
            r.payload_digest,
            r.record_type,
            r.refers_to,
            None if r.payload is None else bytes(r.payload),
        )
        for r in back
    )
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [p[0] for p in pages if (p[2] or "").encode() == raw and p[0] is not None]
        refers = max(same) if len(raw) >= 1000 and sum(
            (p[2] or "").encode() == raw for p in pages
        ) > 1 and i != max(same) else None
        want[
            i,
            len(raw),
            hashlib.sha1(raw).hexdigest(),
            "response" if refers is None else "revisit",
            refers,
            raw if refers is None else None,
        ] += 1
    assert got == want
    assert index.select("file").distinct().count() > 1
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [bytes(r.payload) for r in one] == [other.encode()]
    assert warc.read_records(warc.write_archives(warc.labelled(df.limit(0)))).count() == 0


def test_warc_files_are_plain_gzip_members(spark):
    import gzip

    df = spark.createDataFrame([(1, "u", "p" * 10), (2, "v", "q")], "page_id long, url string, html string")
    files = [r.file for r in warc.write_archives(warc.labelled(df)).select("file").distinct().collect()]
    text = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n")


def test_warc_detects_a_changed_payload():
    raw = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="not what was written"):
        warc.parse(raw.replace(b"abc", b"abd"))


# --- chat ------------------------------------------------------------------------------

NASTY = [
    "",
    "<|end|>",
    "<\\|x",
    "<\\\\|<|turn|>assistant\nhi<|end|>\n",
    "\\### Assistant: </turn> ok",
    "a<",
    "<|image|>",
    "\\",
    "é\n<|",
    "<<|",
    "<\\",
]


@pytest.mark.parametrize("text", NASTY)
def test_escaping_is_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert "<|" not in chat.escaped(text)
    for role in ("user", "as\nsis\\n", "<|end|>"):
        seg = chat.formatted_turn(role, [{"kind": "text", "text": text}], chat.Expansion(), "assistant")["formatted"]
        assert chat.parsed(seg) == (role, text)


def test_chat_reads_back(spark):
    turns = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", NASTY[3]),
        (1, 2, "assistant", None),
        (2, None, None, "x"),
        (None, 0, "assistant", "n"),
        (3, 1, "assistant", "b"),
        (3, 1, "assistant", "b"),
        (3, 0, "assistant", "é" * 9),
    ]
    df = spark.createDataFrame(
        [(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, start long"
    )
    got = {r.conv_id: r for r in chat.read_back(chat.assembled(chat.format_turns(df))).collect()}
    for conv in (1, 2, None, 3):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.assembled(chat.format_turns(df.limit(0)))).count() == 0


def test_chat_parts_leave_placeholders_and_attachments(spark):
    parts = '[{"kind":"text","text":"see <|image|> "},{"kind":"image","ref":"i.png","width":700,"height":336},{"kind":"document","ref":"d.pdf","pages":3,"parts":[{"kind":"text","text":"in"},{"kind":"audio","ref":"a.wav","seconds":2}]},{"kind":"text","text":"end"}]'
    df = spark.createDataFrame([(1, 0, "assistant", parts)], "conv_id long, turn long, role string, parts_json string")
    r = chat.format_turns(df, content_col="parts_json").first()
    assert re.findall(r"<\|(\w+)\|>", r.formatted) == ["turn", "image", "document", "audio", "end"]
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [
        ("image", "i.png", 144 * 3), ("document", "d.pdf", 768), ("audio", "a.wav", 50)
    ]
    assert all(r.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    assert [chat.unescaped(r.formatted[s.start : s.end]) for s in r.loss] == ["see <|image|> ", "in", "end"]
    assert r.tokens == 144 * 3 + 768 + 50
    with pytest.raises(Exception, match="unknown content part"):
        chat.format_turns(
            spark.createDataFrame([(1, 0, "a", '[{"kind":"video"}]')], df.schema), content_col="parts_json"
        ).collect()


# --- tokens ----------------------------------------------------------------------------


def test_tokens_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    # Equal ids follow each other by text.
    rows = sorted(
        ((r.doc_id, r.text or "", r.text is not None) for r in odd.select("doc_id", "text").collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )
    manifest = tokens.write_shards(odd, tokenizer_path(), shard_tokens=40_000)
    assert manifest.count() > 1
    got = sorted(map(tuple, tokens.read_shards(manifest).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc, text, _ in rows:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.read_shards(tokens.write_shards(none, tokenizer_path())).count() == 0


def test_pieces_equal_whole_texts():
    import random

    import pyarrow as pa

    encoder = tokens.Encoder(tokenizer_path())
    assert encoder.by_piece
    rng = random.Random(3)
    alphabet = " \n\t\x0b\x85\u00a0\u3000ab'stl1,.!;é<|>?\u200b\x1f\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, n = encoder.encode(pa.array(texts))
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_repair_is_lossless_with_random_access():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 9, 5000), np.ones(101, dtype=np.int64), np.array([0]), np.array([5, 5, 0, 5, 5, 5, 0])):
        ids = np.append(ids, 0).astype(np.int32)
        sizes = np.diff(np.concatenate(([-1], np.flatnonzero(ids == 0))))
        raw = tokens.packed_shard(ids, sizes, list(range(len(sizes))), 10)
        shard = tokens.Shard.parse(raw)
        ends = np.cumsum(sizes)
        for i in range(len(sizes)):
            assert shard.doc(i).tolist() == ids[ends[i] - sizes[i] : ends[i]].tolist()
        for a in range(0, len(ids), 37):
            assert shard.tokens(a, a + 53).tolist() == ids[a : a + 53].tolist()
    assert len(shard.rules) == 0
    assert len(tokens.repair(np.ones(4096, dtype=np.int32), 10, rules=50, least=8)[0]) < 600


def test_repair_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 1000, 500)
    ids = np.concatenate([[*rng.integers(1, 1000, 7), *passage, 0] for _ in range(2000)])
    seq, rules = tokens.repair(ids, 1000, rules=64_536, least=tokens.worth(2))
    inner = (seq[:-1] != 0) & (seq[1:] != 0)
    assert np.unique(
        seq[:-1][inner].astype(np.int64) << 32 | seq[1:][inner], return_counts=True
    )[1].max() < tokens.worth(2)
    assert len(rules) < 64_536 and len(seq) < 25 * 2000
    # Nonterminals that are fewer than the frequent pairs are all used.
    assert len(tokens.repair(ids, 1000, rules=400, least=8)[1]) == 400
    shard = tokens.Shard.parse(tokens.packed_shard(ids, np.full(2000, 508), list(range(2000)), 1000))
    assert shard.lengths.max() > 8 and (shard.expanded(0, len(shard.symbols)) == ids).all()


# --- URLs ------------------------------------------------------------------------------


def judged_plainly(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [
        (len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        _, rule, verdict = max(fits)
    else:
        rule, verdict = None, "block" if (host, path) in listed else "allow"
    return host, path, rule, verdict


def test_urls_match_plain_rules(spark):
    made = [
        None,
        "",
        "no scheme",
        "http://",
        "http:///x",
        "HTTP://EXAMPLE.ORG/es/1",
        "x://a.b.example.org/en/12?q#f",
        "x://org",
        "x://org/",
        "x://borg/",
        "x://com/de/",
        "x://a.com/fr",
        "x://a.com/fr/x",
        "x://example.org/en/2",
        "x://blocked.net/p?q=1",
        "x://blocked.net/p#z",
        "x://blocked.net/pp",
        "x://a..org/y",
        "x://u@h:80/p://q",
    ]
    urls_ = made * 3
    pages = spark.createDataFrame(
        [(i, u, "k", "h") for i, u in enumerate(urls_)] + [(0, None, "k", "h")],
        "page_id long, url string, rule string, host string",
    )
    listed = {("blocked.net", "/p")}
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = rows_of(
        urls.judged(pages, rules, spark.createDataFrame(list(listed), "host string, path string")).select(
            "page_id", "host", "path", "rule", "verdict"
        )
    )
    want = sorted([(i, *judged_plainly(u, listed)) for i, u in [*enumerate(urls_), (0, None)]], key=repr)
    assert got == want
    assert urls.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_saturated_filter_and_many_rules_change_nothing(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 50}.{('net', 'com', 'org')[i % 3]}/{'de/' if i % 5 else ''}{i % 300}") for i in range(600)],
        "page_id long, url string",
    )
    listed = spark.createDataFrame([(f"h{i % 50}.net", f"/{i}") for i in range(0, 300, 7)], "host string, path string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    want = rows_of(urls.judged(pages, rules, listed))
    assert want == rows_of(urls.judged(pages, rules, listed, max_blocks=1))
    monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    assert want == rows_of(urls.judged(pages.unionAll(pages), rules, listed).distinct()) and urls.judged(
        pages.unionAll(pages), rules, listed
    ).count() == 1200


def test_filter_has_few_false_hits():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    blocks = 20_000 // urls.KEYS
    block, masks = urls._places(keys[:20_000], blocks)
    words = np.zeros((blocks, urls.WORDS), dtype=np.uint64)
    np.bitwise_or.at(words, block, masks)
    bloom = urls.BlockedBloom(blocks, np.arange(blocks), words)
    assert bloom.might(keys[:20_000]).all() and bloom.might(keys[20_000:]).mean() < 0.01


# --- sharding --------------------------------------------------------------------------


def test_shards_are_even_and_match_the_mixture(spark, odd, none):
    n = 1000
    docs = docs_of(spark, [(i, f"t{i}", None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 4}") for i in range(n)])
    out = sharding.interleaved(docs, shards=16, bucket_rows=64).toPandas()
    assert sorted(out["rank"]) == list(range(n)) and sorted(out["doc_id"]) == list(range(n))
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 16
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    share = out.fillna("none").groupby("source").size() / n
    mixed = out.fillna("none").groupby(["shard", "source"]).size().unstack(fill_value=0)
    for source in share.index:
        assert (abs(mixed[source] - counts * share[source]) <= 2).all()
    again = sharding.interleaved(docs.repartition(7), shards=16, bucket_rows=64).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    small = sharding.interleaved(odd, shards=16).collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in small) == want
    assert sharding.interleaved(none).count() == 0


def test_sharding_ranks_as_a_plain_sort(spark):
    import pandas as pd

    docs = docs_of(spark, [(i, f"t{i % 50}", f"s{i % 3}" if i % 2 else "hot") for i in range(400)])
    out = sharding.interleaved(docs, shards=5, bucket_rows=30).toPandas()
    from pyspark.sql import functions as F

    keyed = docs.select(
        "doc_id",
        "source",
        F.xxhash64(
            "doc_id",
            (F.octet_length("text") + 1).cast("long"),
            F.crc32(F.col("text").cast("binary")),
            F.lit(42),
            F.lit(0).cast("long"),
        ).alias("key"),
    ).toPandas()
    keyed["key"] = keyed["key"].astype("int64").to_numpy().view("uint64")
    keyed["r"] = keyed.sort_values("key").groupby("source").cumcount() + 1
    keyed["f"] = (keyed["r"] - 0.5) / keyed.groupby("source")["r"].transform("max")
    by = pd.merge(out[["doc_id", "rank"]], keyed, on="doc_id").sort_values("rank")
    assert by["f"].is_monotonic_increasing


# --- n-gram Jaccard join ---------------------------------------------------------------


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def plain_components(ids, sets):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def jaccard_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = docs_of(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)])
    sets = plain_sets(texts)
    links = [
        sum(bool(a and b) and i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets))
        for i, a in enumerate(sets)
    ]
    want = [(d, len(s), c, n) for d, s, c, n in zip(ids, sets, plain_components(ids, sets), links, strict=True)]
    assert rows_of(
        shingles.linked_components(docs, count=True).select("doc_id", "n_shingles", "component_id", "n_links")
    ) == sorted(want, key=repr)
    assert rows_of(shingles.linked_components(docs)) == sorted([w[:3] for w in want], key=repr)


def near_copies(rng, n_base, copies, words):
    out = []
    for _ in range(n_base):
        base = [f"v{rng.integers(0, 4000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, max(words // 25, 1) + 2))):
                own[int(rng.integers(0, words))] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return out


def test_jaccard_equals_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    texts = near_copies(rng, 6, 12, 60) + near_copies(rng, 4, 5, 7) + near_copies(rng, 2, 4, 600) + [
        "a b c d", "A b\tc  d", "a b c", "", None, " "
    ]
    jaccard_of(spark, texts)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    jaccard_of(spark, [t for _, t in rows], [i for i, _ in rows])


def test_jaccard_with_blocks_split(spark, monkeypatch):
    """Groups larger than a block go through pairs of blocks."""
    monkeypatch.setattr(shingles, "BLOCK_ELEMENTS", 600)
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    texts = near_copies(rng, 1, 60, 50) + near_copies(rng, 1, 20, 58) + near_copies(rng, 5, 3, 40)
    jaccard_of(spark, texts)
    # Bitmaps that say little let more sets pass, and lose none.
    monkeypatch.setattr(shingles, "NODE_BITS", 64)
    jaccard_of(spark, texts[:70])


def test_upper_nodes_keep_strangers_apart(monkeypatch):
    """Of a group that one passage holds together, no set goes on to a block that has nothing else of it."""
    import pyarrow as pa

    rng = np.random.default_rng(7)

    def block(task, sets):
        packed = [np.sort(x).tobytes() for x in sets]
        n = len(sets)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task] * n),
                pa.array([1] * n),
                pa.array(range(100 * task, 100 * task + n)),
                pa.array([1] * n),
                pa.array(packed, pa.binary()),
            ],
            ["task", "root", "node", "weight", "items"],
        )

    def items(n):
        return rng.integers(0, 2**64, n, dtype=np.uint64)

    shared = items(50)
    x, y = ([np.concatenate([shared, items(100)]) for _ in range(40)] for _ in range(2))
    y[3] = np.concatenate([x[5][:145], items(5)])
    (node,) = shingles._upper_nodes(iter([block(2, y)]))
    own, far = block(1, x), node.to_pylist()[0]
    none = pa.array([None], pa.int64())
    held = pa.RecordBatch.from_arrays(
        [
            own.column(0),
            own.column(1),
            pa.array([False] * 40),
            own.column(2),
            own.column(3),
            own.column(4),
            *[pa.nulls(40, pa.int64())] * 3,
        ],
        ["task", "root", "node_too", "node", "weight", "items", "other", "low", "high"],
    )
    against = pa.RecordBatch.from_arrays(
        [
            pa.array([1]),
            pa.array([1]),
            pa.array([True]),
            none,
            none,
            pa.array([far["bitmap"]]),
            pa.array([2]),
            pa.array([far["low"]]),
            pa.array([far["high"]]),
        ],
        held.schema.names,
    )
    passed = [r for b in shingles._passing(iter([held, against]), 80) for r in b.to_pylist()]
    assert [(r["task"], r["node"]) for r in passed] == [(2, 105)]


def test_jaccard_of_empty_table(spark, none):
    assert shingles.linked_components(none).count() == 0


def test_tree_join_at_the_threshold():
    """Sets built to lie exactly at, just under and just over 0.8."""
    items = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def of(*rows):
        rows = [np.sort(items[list(r)]) for r in rows]
        return shingles.Sets(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))

    four, five = of(range(4), range(5)), of(range(9), [*range(8), 50])
    under = of(range(8), [*range(7), 50])
    for sets, n in ((four, 1), (five, 1), (under, 2)):
        labels, _ = shingles.tree_join(sets, np.arange(2), None, 80)
        assert len(set(labels.tolist())) == n
        again, links = shingles.tree_join(sets, np.arange(2), None, 80, np.array([1, 5]))
        assert again.tolist() == labels.tolist() and links.tolist() == ([5, 1] if n == 1 else [0, 0])


# --- toxicity --------------------------------------------------------------------------


def test_toxicity_learns_inflections_and_keeps_clean_texts():
    rng = np.random.default_rng(6)
    stems, ends = ["grubbol", "snarvex"], ["a", "en", "iso", "uld", "ort", "emi", "ax", "ogg"]
    clean = [
        f"{a}{b}{c}" for a in ("ba", "to", "ri", "mel") for b in ("nu", "sha", "lo", "ven") for c in ("", "ra", "ti")
    ]
    texts, labels = [], []
    for i in range(1500):
        words = [clean[j] for j in rng.integers(0, len(clean), int(rng.integers(5, 400)))]
        if i % 6 == 0:
            words[int(rng.integers(0, len(words)))] = stems[i % 2] + ends[int(rng.integers(0, 5))]
        texts.append(" ".join(words))
        labels.append(int(i % 6 == 0))
    model = toxicity.fit(texts[:1200], labels[:1200])
    import pyarrow as pa

    from millstone.llm.words import ALNUM, words_of

    def scores(some):
        return np.concatenate([model.scores(w) for w in words_of(pa.array(some, pa.string()), ALNUM)])

    got = scores(texts[1200:]) >= 0.3
    assert (got == np.array(labels[1200:], dtype=bool)).mean() > 0.97
    unseen = scores([f"banu tosha {stems[0]}{e} riloti" for e in ends[5:]] + ["banu tosha riloti", "", None])
    assert (unseen[:3] >= 0.3).all() and (unseen[3:] < 0.3).all()


def test_toxicity_never_reads_held_out_labels(spark, odd, none):
    labels = spark.createDataFrame(
        [(i, 1, i % 2) for i in range(1, 13)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"
    )
    flipped = labels.selectExpr(
        "doc_id",
        "quality",
        "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic",
    )
    a, b = (rows_of(toxicity.score(odd, toxicity.train(odd, x))) for x in (labels, flipped))
    assert a == b and len(a) == odd.count()
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in a)
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in a)
    model = toxicity.train(none, labels.limit(0))
    assert toxicity.score(none, model).count() == 0
    assert {r.predicted for r in toxicity.score(odd, model).collect()} == {0}


# --- embeddings ------------------------------------------------------------------------


def plain_links(rows, least):
    ids = [r[0] for r in rows]
    ok = [
        r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(
            x is not None and np.isfinite(x) for x in r[1]
        ) and any(r[1])
        for r in rows
    ]
    n, sets = [0] * len(rows), {i: i for i in range(len(rows))}

    def find(x):
        while sets[x] != x:
            x = sets[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    sets[find(i)] = find(j)
    least_id = {}
    for i in range(len(rows)):
        least_id[find(i)] = min(ids[i], least_id.get(find(i), ids[i]))
    return sorted((ids[i], n[i], least_id[find(i)], ids[i] == least_id[find(i)]) for i in range(len(rows)))


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(30):
        base = rng.normal(size=16)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 9))):
            rows.append(
                (
                    len(rows),
                    [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, 0.03, 0.2])],
                    label,
                )
            )
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [
        (2000, rows[0][1], None), (2001, rows[0][1], rows[0][2]), (2002, [1.0, 2.0], 1), (2003, [2.0, 4.0], 1)
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    want = plain_links(rows, 0.98)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == want
    assert sorted(map(tuple, embeddings.near_duplicates(df, leaf_rows=16, block_rows=3, spill=3.0).collect())) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_forest_recall():
    """Pairs at a cosine of just over 0.98 share a leaf of a deep forest."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * side
    forest = embeddings.fit(a, 1 << 19, least=0.98)
    assert len(forest.centres[0]) >= 64 and len(forest.lower[0]) >= 1
    leaves = []
    for x in (a, b):
        row, leaf = forest.leaves(x)
        leaves.append([set(y) for y in np.split(leaf, np.searchsorted(row, np.arange(1, len(x))))])
    assert np.mean([bool(p & q) for p, q in zip(*leaves, strict=True)]) > 0.995


def test_copies_are_numbered(spark):
    from millstone.llm import shared

    counted = spark.createDataFrame([("a", 1), ("b", 7), (None, 25)], "x string, n long")
    got = Counter(map(tuple, shared.numbered(counted, "n", run=10).collect()))
    assert got == Counter([("a", 0), *(("b", i) for i in range(7)), *((None, i) for i in range(25))])


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, one_task):
    from millstone.llm import components as c

    monkeypatch.setattr(c, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [
        (300, 301), (301, 302), (302, 300), (5, 5), (260, 7), (-4, 300), (-4, 300)
    ]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 261)} | {i: -4 for i in (300, 301, 302)}
    assert dict(map(tuple, c.components(df).collect())) == want
    assert c.components(df.limit(0)).count() == 0


def test_embeddings_of_deep_trees(spark):
    """A made table with thousands of links, in trees deeper than the sample reaches: recall against brute force, and
    exact counts."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(700, 32))
    rows = [
        (base[i % 700] + rng.normal(size=32) * rng.choice([0.0, 0.02, 0.1, 0.15])).astype(np.float32)
        for i in range(2800)
    ]
    unit = np.stack(rows).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    links = int(near.sum() - len(rows)) // 2
    df = spark.createDataFrame(
        [(i, [float(x) for x in r], 1) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int"
    )
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf_rows=8).collect()}
    assert links > 2000 and sum(r.n_links for r in got.values()) / 2 / links > 0.9
    assert all(r.n_links <= near[i].sum() - 1 for i, r in got.items())
    exact = {
        r.vec_id: r.n_links for r in embeddings.near_duplicates(df, leaf_rows=256, spill=2.0, block_rows=300).collect()
    }
    assert exact == {i: int(near[i].sum()) - 1 for i in range(len(rows))}


# --- decontamination -------------------------------------------------------------------


def plain_hits(text, items, n=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    w = find(text)
    hit, seen = set(), set()
    for item, t in items:
        v = find(t)
        k = min(n, len(v))
        own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in own:
                hit.update(range(i, i + k))
                seen.add(str(item))
    return len(w), len(hit), len(seen), hashlib.sha256(
        ",".join(sorted(seen)).encode()
    ).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_equals_brute_force(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(20))
    items = [(1, item), (2, "Tiny, item!"), (3, None), (4, ""), (10, item + " more"), (5, "é 你好"), (6, "solo")]
    texts = [
        "x " * 300 + item + " y" * 300,
        item[:-4],
        "a tiny  ITEM b",
        "solo solo",
        "tiny-item",
        "pre q0 q1 q2 " + item.upper(),
        "né 你好",
        None,
        "",
        "É é 你好 end",
        "solo " + "z " * 30,
    ]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")]).withColumnRenamed(
        "source", "n_hit"
    )
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    want = sorted([(i, *plain_hits(t, items)) for i, t in [*enumerate(texts), (0, texts[0])]], key=repr)
    assert rows_of(decontam.judge(docs, bench)) == want
    # A benchmark in many slices gives the same.
    assert rows_of(decontam.judge(docs, bench, slice_bytes=40)) == want
    assert decontam.judge(none, bench).count() == 0
    assert {r.n_hit for r in decontam.judge(docs, bench.limit(0)).collect()} == {0}
    assert decontam.judge(odd, bench).count() == odd.count()
    kept = {r.doc_id: r for r in decontam.clean(docs.where("doc_id > 0"), bench).collect()}
    assert {r.doc_id: r for r in decontam.clean(docs.where("doc_id > 0"), bench, slice_bytes=40).collect()} == kept
    bad = {w[0] for w in want if w[-1]}
    assert set(kept) == set(range(1, len(texts))) - bad
    assert kept[7].text is None and kept[8].text == ""
    spans = decontam.clean(docs_of(spark, [(1, "a " * 600 + item + ". b", "s")]), bench).first()
    assert spans.text == "a " * 600 + ". b" and spans.n_chars == len(spans.text)


def test_benchmark_items_without_an_id(spark):
    import duckdb

    from millstone.llm.queries import ORACLES

    known, other, third = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    docs = docs_of(
        spark,
        [
            (1, known, "s"),
            (2, other, "s"),
            (3, f"{known} {other} {third}", "s"),
            (4, "x " * 900 + other, "s"),
            (5, "clean", "s"),
        ],
    )
    bench = spark.createDataFrame([(1, known), (None, other), (None, third), (2, None)], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    want = con.execute(ORACLES["op10_decontamination"])
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    for slice_bytes in (8 << 20, 40):
        assert sorted(
            map(tuple, decontam.judge(docs, bench, slice_bytes=slice_bytes).select(*columns).collect())
        ) == want
    assert [dict(zip(columns, r, strict=True))["n_items"] for r in want] == [1, 1, 2, 1, 0]
    assert {r.doc_id: r.text.split() for r in decontam.clean(docs, bench).collect()} == {4: ["x"] * 900, 5: ["clean"]}
