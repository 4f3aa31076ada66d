"""URL filters: listed canonical URLs in a blocked Bloom filter, verified by an exact hash join.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; its path is the rest up to ``?``, ``#`` or the end. Listed entries are
(host, path) keys of two kinds: a rule fits its host and all subdomains where the URL's
path starts with the rule's (the longest host, then the longest path, wins); a listed page
fits the one canonical URL (host and path) alone.

Every key is hashed to one 512-bit block of the filter and to eight bits in it. The filter
is built by grouped ``bit_or`` over the list, so the list is never gathered; its size
follows the list up to ``max_blocks`` (a fixed bound on what is broadcast). Beyond that
the filter lets more false hits through and results stay the same, because every possible
hit goes to an exact join on the key, which settles it. Lookups of a URL are its host
suffixes times the path lengths that rules have, and the whole URL.

Rules up to ``LITERAL_RULES`` are looked up in a map that the plan holds, where the page is read; more of
them go through the filter and the join as well. Only pages that the filter lets through are
shuffled, by their key; all others are judged where they are read.

Null URLs and URLs without ``://`` have an empty host and path: no rule fits, and they are
allowed. Repeated URLs are judged row by row; a hot URL or host only meets the listed side,
which holds each key once. An empty list allows everything; an empty table of pages gives no
rows. Other columns are not read, whatever their names. A long URL costs its number of host labels
times the path lengths of the rules in keys, each at most as long as the URL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: 64-bit words of a block; bits set per key; keys per block aimed at (16 bits a key).
WORDS, BITS, KEYS = 8, 8, 32
#: Blocks of a filter at most: 16 MiB.
MAX_BLOCKS = 1 << 18
#: Rules that are looked up in a literal map, and that are broadcast to a join, at most.
LITERAL_RULES, BROADCAST_RULES = 200, 50_000


def url_host(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Path of a URL; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(kind: str, host: Column, path: Column) -> Column:
    """The text that listed entries and lookups are compared by."""
    return F.concat_ws("\x01", F.lit(kind), host, path)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its mask of ``WORDS`` words. Mirrors ``_masks``."""
    u = h.astype(np.uint64)
    block = (u >> np.uint64(16)) % np.uint64(blocks)
    low = (u & np.uint64(0xFFFF)) | ((u >> np.uint64(48)) << np.uint64(16)) | (
        (u * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)
    )
    masks = np.stack([np.uint64(1) << ((low >> np.uint64(6 * i)) & np.uint64(63)) for i in range(WORDS)], axis=1)
    return block.astype(np.int64), masks


class BlockedBloom:
    """A filter of ``blocks`` blocks; ``might(hashes)`` never misses a listed key."""

    def __init__(self, blocks: int, ids: np.ndarray, words: np.ndarray) -> None:
        self.words = np.zeros((blocks, WORDS), dtype=np.uint64)
        self.words[ids] = words

    def might(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = _places(hashes, len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)


def bloom_of(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """The filter of a list's distinct ``key`` column; at most ``max_blocks`` rows reach the driver."""
    blocks = min(max_blocks, keys.count() // KEYS + 1)
    hashed = keys.select(F.xxhash64("key").alias("h"))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            block, masks = _places(pdf["h"].to_numpy(), blocks)
            order = np.argsort(block, kind="stable")
            ids, first = np.unique(block[order], return_index=True)
            merged = np.bitwise_or.reduceat(masks[order], first, axis=0).view(np.int64) if len(ids) else np.zeros(
                (0, WORDS), np.int64
            )
            yield pd.DataFrame({"block": ids} | {f"w{i}": merged[:, i] for i in range(WORDS)})

    names = [f"w{i}" for i in range(WORDS)]
    merged = hashed.mapInPandas(parts, "block long, " + ", ".join(f"{x} long" for x in names)).groupBy("block").agg(
        *[F.bit_or(x).alias(x) for x in names]
    )
    pdf = merged.toPandas()
    return BlockedBloom(
        blocks, pdf["block"].to_numpy(np.int64), pdf[names].to_numpy(np.int64).view(np.uint64).reshape(-1, WORDS)
    )


def judged(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed (whether its canonical URL is on the list).

    ``rules``: host, path, verdict (allow or block). ``listed``: host, path of blocked pages.
    The longest fitting rule decides; without one, a listed URL is blocked and any other allowed.
    """
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    ruled = rules.select(
        _key("rule", F.col("host"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("said"),
    ).dropDuplicates(["key"])
    given = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    nothing = F.array().cast("array<string>")
    stems = F.array_compact(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    ) if lengths else nothing
    looked = F.flatten(F.transform(hosts, lambda h: F.transform(stems, lambda p: _key("rule", h, p))))
    keys = F.when(F.col("host") == "", nothing).otherwise(looked)
    few = ruled.limit(LITERAL_RULES + 1).collect()
    if len(few) <= LITERAL_RULES:
        known = {r.key: (r.rule, r.said) for r in few}
        at = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v[0])]) if known else F.lit(None).cast(
            "map<string,string>"
        )
        by_rule = F.create_map(*[F.lit(x) for _, v in known.items() for x in v]) if known else F.lit(None).cast(
            "map<string,string>"
        )
        fitting = F.array_compact(F.transform(keys, lambda k: at[k]))
        longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r).alias("n"), r.alias("rule"))))["rule"]
        best = given.withColumn("rule", longest).withColumn("said", by_rule[F.col("rule")])
    else:
        best = _ruled_by_join(given.withColumn("keys", keys), ruled, max_blocks)
    out = [
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "listed",
    ]
    if listed is None:
        return best.withColumn("listed", F.lit(False)).select(*out)
    paged = listed.select(_key("page", F.col("host"), F.col("path")).alias("key")).distinct().withColumn(
        "on", F.lit(True)
    )
    might = _filter(paged, max_blocks)
    marked = best.withColumn("key", _key("page", F.col("host"), F.col("path"))).withColumn(
        "might", (F.col("host") != "") & might(F.xxhash64("key"))
    )
    there = marked.where("might").join(paged, "key", "left").withColumn("listed", F.coalesce("on", F.lit(False)))
    return marked.where(~F.col("might")).withColumn("listed", F.lit(False)).select(*out).unionByName(there.select(*out))


def _filter(keys: DataFrame, max_blocks: int) -> Callable[[Column], Column]:
    """Whether a key's hash might be among the listed keys, as a column function."""
    bloom = keys.sparkSession.sparkContext.broadcast(bloom_of(keys.select("key"), max_blocks))

    @arrow_udf("boolean")
    def might(hashes: pa.Array) -> pa.Array:
        return pa.array(bloom.value.might(np.asarray(hashes)))

    return might


def _ruled_by_join(given: DataFrame, ruled: DataFrame, max_blocks: int) -> DataFrame:
    """page_id, host, path, rule, said of every page by many rules: possible hits meet the rules in an exact join."""
    might = _filter(ruled, max_blocks)
    none = F.lit(None).cast("string")
    rows = given.select("page_id", "host", "path", none.alias("rule"), none.alias("said"), F.lit(1).alias("n"))
    hits = given.withColumn("key", F.explode("keys")).drop("keys").where(might(F.xxhash64("key")))
    found = hits.join(F.broadcast(ruled) if ruled.count() <= BROADCAST_RULES else ruled, "key").select(
        "page_id", "host", "path", "rule", "said", F.lit(0).alias("n")
    )
    # A page's row comes again, with or without a hit; equal rows are counted.
    best = F.max(
        F.when(
            F.col("rule").isNotNull(),
            F.struct(F.length("rule"), F.col("rule").alias("rule"), F.col("said").alias("said")),
        )
    )
    per = rows.unionByName(found).groupBy("page_id", "host", "path").agg(best.alias("best"), F.sum("n").alias("n"))
    again = per.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.col("best.said").alias("said"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    )
    return again.drop("copy")
