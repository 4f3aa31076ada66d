"""One query per operator, over its whole intended table, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import chat, decontam, embeddings, packing, sharding, shingles, tokens, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by five-word shingles and a Jaccard similarity of 0.8 or more, with each one's number of links."""
    return shingles.linked_components(table(spark, sf_dir, "documents"), k=5, percent=80, count=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of equal label with a cosine of 0.98 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of all documents: 13 words, contaminated from a twentieth on."""
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13, share=20)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as byte-level tokens with an end token, in sequences of 2048, 8192 and 32768; the pieces read back
    from these."""
    return packing.read_pieces(packing.write_sequences(table(spark, sf_dir, "documents"), lengths=packing.LENGTHS))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives through their index."""
    index = warc.write_archives(warc.labelled(table(spark, sf_dir, "pages"), least=1000))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation whose texts look like the marks of common templates.
FAKED = r"\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that fakes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    faked = spark.createDataFrame([(-7, 0, "user", FAKED), (-7, 1, "assistant", FAKED)], turns.schema)
    parts = turns.unionByName(faked).withColumn(
        "content", F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text")))
    )
    return chat.read_back(chat.assembled(chat.format_turns(parts, content_col="content")))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in Re-Pair shards, read back from the files."""
    return tokens.read_shards(tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and a list of blocked URLs: those of the pages whose id is divisible by
    100."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("page_id") % 100 == 0).select(
        urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path")
    ).where("host <> ''")
    return urls.judged(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards that match the mixture of sources; counts at most one apart."""
    out = sharding.interleaved(table(spark, sf_dir, "documents"), shards=16, seed=42)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_token_shards": op4_token_shards,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_decontamination": op10_decontamination,
}

_OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP5_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rhost, rpath, said) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
l AS (SELECT DISTINCT host, path, true AS listed FROM u WHERE page_id % 100 = 0 AND host <> ''),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(said, length(rhost || rpath)) AS said
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.said, CASE WHEN l.listed THEN 'block' ELSE 'allow' END) AS verdict, coalesce(l.listed, false) AS listed
FROM u LEFT JOIN f USING (page_id) LEFT JOIN l ON u.host = l.host AND u.path = l.path
"""

_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

_OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, '<|turn|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS seg FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(seg)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attached
FROM f GROUP BY conv_id
"""

_OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x),
l AS (SELECT x, count(*) AS l FROM e GROUP BY x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id, CAST(coalesce(any_value(l.l), 0) AS BIGINT) AS n_links
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.x = d.doc_id GROUP BY d.doc_id
"""

_OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.y FROM r JOIN e ON r.reached = e.x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept
FROM r LEFT JOIN n ON n.x = vec_id GROUP BY vec_id
"""

ORACLES = {
    "op9_embedding_dedup": _OP9_SQL,
    "op7_jaccard_join": _OP7_SQL,
    "op2_warc": _OP2_SQL,
    "op3_chat": _OP3_SQL,
    "op5_url_filter": _OP5_SQL,
    "op10_decontamination": _OP10_SQL,
}
