"""Headline queries: every operator over the star schema, each with its SQL where SQL can state it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millstone import functions as M
from millstone.operators import cdf_by, cdf_column, digest_by, merge_by, quantiles_by, rollup_by, with_digest
from millstone.plans import sql
from millstone.sources import read_digest_files, read_values, write_digest_files
from millstone.streaming import running_digests, windowed_points

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROBES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
XS = [0.5, 10.0, 25.5, 50.0, 60.0]
FLAGS = ["l_returnflag", "l_linestatus"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or local where that is unset and
    the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millstone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _by_flag(spark: SparkSession, sf_dir: str, **settings: object) -> DataFrame:
    return digest_by(table(spark, sf_dir, "lineitem"), FLAGS, "l_quantity", **settings)


# --- build and query -------------------------------------------------------------------


@query(sql.quantiles("lineitem", FLAGS, "l_quantity", PROBES))
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantiles_by(_by_flag(spark, sf_dir), PROBES), "value")


@query(sql.cdfs("lineitem", FLAGS, "l_quantity", XS))
def cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cdf_by(_by_flag(spark, sf_dir), XS), "share")


@query(sql.medians("part", ["p_brand"], "p_size"))
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        digest_by(table(spark, sf_dir, "part"), ["p_brand"], "p_size").select(
            "p_brand", M.median("digest").alias("median")
        ),
        "median",
    )


@query(sql.trimmed("lineitem", FLAGS, "l_quantity", 0.1, 0.9))
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        _by_flag(spark, sf_dir).select(*FLAGS, M.trimmed_mean("digest", 0.1, 0.9).alias("trimmed")), "trimmed"
    )


_STATS = "count(*) * 1.0::DOUBLE AS n, round(sum({v}), 2) AS total, min({v}) AS low, max({v}) AS high, round(avg({v}), 6) AS mean"


def _stats(d: DataFrame, *keys: str) -> DataFrame:
    x = F.col("digest")
    return d.select(
        *keys,
        x["count"].alias("n"),
        F.round(x["sum"], 2).alias("total"),
        x["min"].alias("low"),
        x["max"].alias("high"),
        F.round(M.digest_mean("digest"), 6).alias("mean"),
    )


@query(f"SELECT l_returnflag, l_linestatus, {_STATS.format(v='l_extendedprice')} FROM lineitem GROUP BY ALL")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a column that is nearly unique, so centroids are blended: the stats stay exact."""
    return _stats(digest_by(table(spark, sf_dir, "lineitem"), FLAGS, "l_extendedprice"), *FLAGS)


@query(sql.quantiles("lineitem", ["l_returnflag"], "l_discount", PROBES, weight="l_quantity"))
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        quantiles_by(digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"), PROBES),
        "value",
    )


@query(sql.cdfs("lineitem", ["l_returnflag"], "l_discount", [0.0, 0.03, 0.055, 0.1], weight="l_quantity"))
def weighted_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        cdf_by(
            digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"),
            [0.0, 0.03, 0.055, 0.1],
        ),
        "share",
    )


@query(
    "SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DOUBLE) AS mean, count(*) * 1.0::DOUBLE AS weight, true AS atomic FROM lineitem GROUP BY ALL"
)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_flag(spark, sf_dir).select(*FLAGS, F.inline("digest.centroids"))


@query(
    "WITH a AS (" + sql.quantiles("lineitem", FLAGS, "l_quantity", [0.5]) + ")\n"
    "SELECT l_returnflag, l_linestatus, format('TDigest(n={}, k=1000, min={:.6f}, p50={:.6f}, max={:.6f}, centroids={})', count(*), min(l_quantity), any_value(value), max(l_quantity), count(DISTINCT l_quantity)) AS summary"
    " FROM lineitem JOIN a USING (l_returnflag, l_linestatus) GROUP BY ALL"
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_flag(spark, sf_dir).select(*FLAGS, M.tdigest_summary("digest").alias("summary"))


@query(
    "WITH s AS (SELECT vec_id, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings)\n"
    "SELECT vec_id, round((s[32] + s[33]) / 2, 6) AS p50, round((s[16] + s[17]) / 2, 6) AS p25, round(s[1], 6) AS low, round(s[64], 6) AS high FROM s"
)
def array_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each row's array."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", M.tdigest_of_array("embedding").alias("digest"))
    q = M.quantile("digest", [0.5, 0.25, 0.0, 1.0])
    return d.select("vec_id", q.alias("q")).select(
        "vec_id", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p25", "low", "high"))]
    )


@query(sql.quantiles("lineitem", ["l_returnflag"], "l_quantity", PROBES))
def from_centroid_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of arrays of means and weights; a group's distinct quantities are few by their nature."""
    points = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("w"))
    arrays = points.groupBy("l_returnflag").agg(F.collect_list(F.struct("l_quantity", "w")).alias("a"))
    return _rounded(
        quantiles_by(
            arrays.select("l_returnflag", M.from_centroids(F.col("a.l_quantity"), F.col("a.w")).alias("digest")),
            PROBES,
        ),
        "value",
    )


# --- settings --------------------------------------------------------------------------


def _mode_query(mode: str, **settings: object) -> None:
    """Quantiles of few distinct values, which no way of building changes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(quantiles_by(_by_flag(spark, sf_dir, mode=mode, **settings), PROBES), "value")

    run.__name__ = f"quantiles_{mode}"
    query(sql.quantiles("lineitem", FLAGS, "l_quantity", PROBES))(run)


_mode_query("hashed", shards=300)
_mode_query("partial")


@query(
    "SELECT l_returnflag, l_linestatus, q, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM ("
    + sql.quantiles("lineitem", FLAGS, "l_quantity", PROBES)
    + ")"
)
def quantiles_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of f32 digests, whose quantiles are floats."""
    got = quantiles_by(_by_flag(spark, sf_dir, precision="f32"), PROBES)
    return got.withColumn("value", F.round(F.col("value").cast("double"), 4))


# --- blended digests: far more distinct values than centroids ---------------------------

SIZE = 200


def _points(value: str = "CAST(l_extendedprice AS DOUBLE)", weight: str = "1", key: str = "l_returnflag") -> str:
    return f"WITH src AS (SELECT {key} AS k, {value} AS m, CAST(sum({weight}) AS DOUBLE) AS w, true AS a FROM lineitem GROUP BY k, m),\n"


def _prices(spark: SparkSession, sf_dir: str, weight: str | None = None, **settings: object) -> DataFrame:
    sized = settings if "delta" in settings else {"max_size": SIZE} | settings
    return digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", weight, **sized)


def _clusters(digests: DataFrame) -> DataFrame:
    """Centroids one by one. Means are moved a little before rounding: many lie halfway between two decimals."""
    out = digests.select("l_returnflag", F.inline("digest.centroids"))
    return out.select(
        "l_returnflag",
        F.round(F.col("mean").cast("double") + 0.000000123, 6).alias("mean"),
        F.col("weight").cast("double").alias("weight"),
        "atomic",
    )


def _blended_query(name: str, oracle: str, weight: str | None = None, **settings: object) -> None:
    """All centroids of a digest that has to blend, by scale, policy, delta, weight or precision."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _clusters(_prices(spark, sf_dir, weight, **settings))

    run.__name__ = name
    query(f"{oracle}\n{sql.clusters('l_returnflag')}")(run)


for _scale in sql.SCALES:
    _blended_query(f"blended_{_scale}", _points() + sql.blended("src", SIZE, _scale), scale=_scale)
_blended_query("blended_off", _points() + sql.blended("src", SIZE, policy="off"), singleton_policy="off")
_blended_query(
    "blended_edges",
    _points() + sql.blended("src", SIZE, policy="edges", pin=5),
    singleton_policy="edges",
    pin_per_side=5,
)
_blended_query("blended_delta", _points() + sql.delta_clusters("src", 100.0), delta=100.0)
_blended_query("blended_weighted", _points(weight="l_quantity") + sql.blended("src", SIZE), weight="l_quantity")
_F32 = "f AS (SELECT k, CAST(CAST(m AS FLOAT) AS DOUBLE) AS m, w, a FROM d)\n" + sql.clusters("l_returnflag", "f")


@query(_points() + sql.blended("src", SIZE) + "\n" + sql.clusters("l_returnflag"))
def blended_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of values that are streamed through the kernel is that of all at once."""
    return _clusters(_prices(spark, sf_dir, mode="streamed"))


@query(_points("CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE)") + sql.blended("src", SIZE) + ",\n" + _F32)
def blended_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(_prices(spark, sf_dir, precision="f32"))


@query(_points() + sql.blended("src", SIZE) + "\n" + sql.clusters("l_returnflag"))
def blended_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of both kinds through bytes and back."""
    return _clusters(_prices(spark, sf_dir).select("l_returnflag", M.from_bytes(M.to_bytes("digest")).alias("digest")))


@query(
    _points(key="l_returnflag || l_linestatus || month(l_shipdate)")
    + sql.blended("src", SIZE, name="part")
    + ",\nboth_ AS (SELECT k[1] AS k, m, sum(w) AS w, bool_and(a) AS a FROM part GROUP BY 1, 2),\n"
    + sql.blended("both_", SIZE)
    + "\n"
    + sql.clusters("l_returnflag")
)
def blended_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended digests by flag, status and month, merged by flag in one pass."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))
    return _clusters(merge_by(digest_by(rows, [*FLAGS, "month"], "l_extendedprice", max_size=SIZE), ["l_returnflag"]))


@query(sql.blended_quantiles(_points() + sql.blended("src", SIZE), "l_returnflag", PROBES))
def blended_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantiles_by(_prices(spark, sf_dir), PROBES), "value")


PRICES = [0.0, 950.5, 5000.0, 25_000.25, 70_000.0, 104_000.0, 200_000.0]


@query(sql.blended_cdfs(_points() + sql.blended("src", SIZE), "l_returnflag", PRICES))
def blended_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cdf_by(_prices(spark, sf_dir), PRICES), "share")


@query(sql.k1_clusters("lineitem", "l_returnflag", "l_extendedprice", 1000))
def k1_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended centroids, cluster by cluster. Means are moved a little before rounding: many lie halfway between two
    decimals."""
    d = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", scale="k1")
    return d.select("l_returnflag", F.inline("digest.centroids")).select(
        "l_returnflag", F.round(F.col("mean") + 0.0000123, 4).alias("mean"), "weight"
    )


def _rank_query(name: str, oracle: str, **settings: object) -> None:
    """Per probe the share of rows at or below the estimate, which is what a digest's accuracy is measured by."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem")
        got = _rounded(quantiles_by(_prices(spark, sf_dir, **settings), PROBES), "value")
        probes = got.groupBy("l_returnflag").agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("p"))
        below = [
            F.avg(
                (F.col("l_extendedprice").cast("double") <= F.element_at("p", i + 1)["value"]).cast("double")
            ).alias(f"s{i}")
            for i in range(len(PROBES))
        ]
        ranks = rows.select("l_returnflag", "l_extendedprice").join(probes, "l_returnflag").groupBy(
            "l_returnflag"
        ).agg(*below)
        listed = F.array(
            *[F.struct(F.lit(q).alias("q"), F.round(F.col(f"s{i}"), 6).alias("share")) for i, q in enumerate(PROBES)]
        )
        return ranks.select("l_returnflag", F.inline(listed))

    run.__name__ = name
    estimates = sql.blended_quantiles(_points() + oracle, "l_returnflag", PROBES)
    query(
        f"SELECT l_returnflag, q, round(avg(CASE WHEN CAST(l_extendedprice AS DOUBLE) <= value THEN 1.0 ELSE 0 END), 6) AS share FROM lineitem JOIN ({estimates}) USING (l_returnflag) GROUP BY ALL"
    )(run)


for _scale in ("k2", "k3", "quad"):
    _rank_query(f"rank_error_{_scale}", sql.blended("src", SIZE, _scale), scale=_scale)
_rank_query("rank_error_delta", sql.delta_clusters("src", 100.0), delta=100.0)


@query(f"SELECT l_returnflag, {_STATS.format(v='l_extendedprice')} FROM lineitem GROUP BY ALL")
def delta_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(
        digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", delta=300.0), "l_returnflag"
    )


@query(
    "WITH d AS (SELECT DISTINCT l_returnflag, l_extendedprice AS m FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m) AS i, count(*) OVER (PARTITION BY l_returnflag) AS k FROM d)\n"
    "SELECT l_returnflag, round(m, 4) AS mean FROM r WHERE i <= 5 OR i > k - 5"
)
def pinned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer five values of either side stay as they are."""
    d = digest_by(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", singleton_policy="edges", pin_per_side=5
    )
    outer = F.concat(F.slice("digest.centroids", 1, 5), F.slice("digest.centroids", -5, 5))
    return d.select("l_returnflag", F.inline(outer)).select("l_returnflag", F.round("mean", 4).alias("mean"))


# --- merge and change ------------------------------------------------------------------


@query(sql.quantiles("lineitem", ["l_returnflag"], "l_quantity", PROBES))
def merged_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests per month, merged."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    return _rounded(
        quantiles_by(merge_by(digest_by(rows, ["l_returnflag", "month"], "l_quantity"), ["l_returnflag"]), PROBES),
        "value",
    )


def _grouping(kind: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) * 1.0::DOUBLE AS n, round(sum(CASE WHEN l_quantity < 25 THEN 1.0 WHEN l_quantity = 25 THEN 0.5 ELSE 0 END) / count(*), 6) AS share FROM lineitem GROUP BY {kind}(l_returnflag, l_linestatus)"


@query(_grouping("ROLLUP"))
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup_by(table(spark, sf_dir, "lineitem"), FLAGS, "l_quantity")
    return _rounded(
        d.select(*FLAGS, "level", F.col("digest.count").alias("n"), M.cdf("digest", 25.0).alias("share")), "share"
    )


@query(_grouping("CUBE"))
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup_by(table(spark, sf_dir, "lineitem"), FLAGS, "l_quantity", cube=True)
    return _rounded(
        d.select(*FLAGS, "level", F.col("digest.count").alias("n"), M.cdf("digest", 25.0).alias("share")), "share"
    )


_ADDED = "v AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, 1.0 AS w FROM lineitem UNION ALL SELECT f, y, w FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (VALUES (100.0, {a}), (-1.0, {b}), (7.0, {c})) t(y, w)),"


@query(sql.quantiles("v", ["l_returnflag"], "x", PROBES, weight="w", with_=_ADDED.format(a=1, b=1, c=1)))
def add_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    more = M.add_values(M.add_values("digest", 100.0), [-1.0, 7.0])
    return _rounded(quantiles_by(d.select("l_returnflag", more.alias("digest")), PROBES), "value")


@query(sql.quantiles("v", ["l_returnflag"], "x", PROBES, weight="w", with_=_ADDED.format(a=500, b=2500, c=30)))
def add_weighted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    more = M.add_weighted_values("digest", [100.0, -1.0, 7.0], [500.0, 2500.0, 30.0])
    return _rounded(quantiles_by(d.select("l_returnflag", more.alias("digest")), PROBES), "value")


@query(sql.quantiles("lineitem", ["l_returnflag"], "l_quantity", PROBES, weight="3.0", times=2))
def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights times 3, values times 2."""
    d = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return _rounded(
        quantiles_by(
            d.select("l_returnflag", M.scale_values(M.scale_weights("digest", 3.0), 2.0).alias("digest")), PROBES
        ),
        "value",
    )


@query(
    "SELECT l_returnflag, 'f32' AS precision, count(*) * 1.0::DOUBLE AS n, round(CAST(CAST(max(l_discount) AS FLOAT) AS DOUBLE), 6) AS high, round(sum(l_discount), 2) AS total FROM lineitem GROUP BY ALL"
)
def cast_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount").select(
        "l_returnflag", M.cast_precision("digest", "f32").alias("digest")
    )
    x = F.col("digest")
    return d.select(
        "l_returnflag",
        M.wire_precision(M.to_bytes(x)).alias("precision"),
        x["count"].alias("n"),
        F.round(x["max"].cast("double"), 6).alias("high"),
        F.round(x["sum"], 2).alias("total"),
    )


@query(
    "SELECT n_name, count(s_suppkey) FILTER (s_acctbal > 9000) * 1.0::DOUBLE AS n, min(s_acctbal) FILTER (s_acctbal > 9000) AS low, count(s_suppkey) FILTER (s_acctbal > 9000) = 0 AS nothing"
    " FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"
)
def empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join leaves null digests; merged, they are empty: null quantiles, NaN shares."""
    d = digest_by(table(spark, sf_dir, "supplier").where("s_acctbal > 9000"), ["s_nationkey"], "s_acctbal")
    joined = table(spark, sf_dir, "nation").join(d, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    m = merge_by(joined, ["n_name"])
    share = M.cdf("digest", float("inf"))
    return m.select(
        "n_name",
        F.col("digest.count").alias("n"),
        M.quantile("digest", 0.0).alias("low"),
        F.isnan(share).alias("nothing"),
    )


_OVER = (
    "SELECT p_partkey, round(w.c, 6) AS share FROM part JOIN (SELECT a.p_brand AS b, avg(CASE WHEN a.p_size < 20 THEN 1.0 WHEN a.p_size = 20 THEN 0.5 ELSE 0 END) AS c FROM part a GROUP BY a.p_brand) w ON p_brand = w.b"
)


@query(_OVER)
def joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its brand's share, which is worked out once a brand and joined: a number goes with each row, not a
    digest."""
    parts = table(spark, sf_dir, "part")
    shares = digest_by(parts, ["p_brand"], "p_size").select("p_brand", M.cdf("digest", 20.0).alias("share"))
    return _rounded(parts.select("p_partkey", "p_brand").join(shares, "p_brand").select("p_partkey", "share"), "share")


@query(_OVER)
def with_its_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its brand's digest, by a join."""
    return _rounded(
        with_digest(table(spark, sf_dir, "part"), ["p_brand"], "p_size").select(
            "p_partkey", M.cdf("digest", 20.0).alias("share")
        ),
        "share",
    )


@query(
    "SELECT p_partkey, round(avg(CASE WHEN s < p_size THEN 1.0 WHEN s = p_size THEN 0.5 ELSE 0 END), 6) AS share FROM"
    " (SELECT p_partkey, p_size, unnest(list(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS 9 PRECEDING)) AS s FROM part) GROUP BY p_partkey"
)
def over_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's size among the last ten of its brand, by a digest of a sliding frame."""
    last = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-9, 0)
    d = table(spark, sf_dir, "part").select("p_partkey", "p_size", M.tdigest("p_size").over(last).alias("digest"))
    return _rounded(d.select("p_partkey", M.cdf("digest", F.col("p_size")).alias("share")), "share")


@query(
    "SELECT p_partkey, round((SELECT avg(CASE WHEN a.p_size < p.p_size THEN 1.0 WHEN a.p_size = p.p_size THEN 0.5 ELSE 0 END) FROM part a WHERE a.p_size > 10), 6) AS share FROM part p"
)
def column_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of values against one digest."""
    parts = table(spark, sf_dir, "part")
    return _rounded(
        cdf_column(
            parts.select("p_partkey", "p_size"),
            "p_size",
            digest_by(parts.where("p_size > 10"), [], "p_size"),
            alias="share",
        ).select("p_partkey", "share"),
        "share",
    )


@query(_OVER)
def over_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate over a window: every row has its brand's digest."""
    d = table(spark, sf_dir, "part").select(
        "p_partkey", M.tdigest("p_size").over(Window.partitionBy("p_brand")).alias("digest")
    )
    return _rounded(d.select("p_partkey", M.cdf("digest", 20.0).alias("share")), "share")


@query(sql.quantiles("(SELECT * FROM customer WHERE c_acctbal > 0)", ["c_mktsegment"], "c_acctbal", [0.25, 0.5, 0.75]))
def plain_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate in ``agg``, on a filtered column."""
    d = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(
        M.tdigest("c_acctbal").alias("digest")
    )
    return _rounded(quantiles_by(d, [0.25, 0.5, 0.75]), "value")


@query(
    "SELECT event_type, count(*) * 1.0::DOUBLE AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type UNION ALL SELECT 'all', count(*) * 1.0::DOUBLE, min(value), max(value) FROM events"
)
def union_of_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest_by(table(spark, sf_dir, "events"), ["event_type"], "value")
    whole = d.unionAll(merge_by(d, []).select(F.lit("all").alias("event_type"), "digest"))
    return whole.select(
        "event_type",
        F.col("digest.count").alias("n"),
        F.col("digest.min").alias("low"),
        F.col("digest.max").alias("high"),
    )


# --- bytes, files, SQL -----------------------------------------------------------------


def _wire_query(version: int) -> None:
    """Digests of distinct values, so that version 1, which keeps no kinds, gives the same answers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "embeddings").select("vec_id", M.tdigest_of_array("embedding").alias("digest"))
        back = d.select("vec_id", M.from_bytes(M.to_bytes("digest", version)).alias("digest"))
        return _rounded(
            back.select("vec_id", M.quantile("digest", 0.5).alias("p50"), F.col("digest.count").alias("n")), "p50"
        )

    run.__name__ = f"wire_v{version}"
    query(
        "WITH s AS (SELECT vec_id, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings) SELECT vec_id, round((s[32] + s[33]) / 2, 6) AS p50, 64.0::DOUBLE AS n FROM s"
    )(run)


for _version in (1, 2, 3):
    _wire_query(_version)


@query(
    "SELECT l_returnflag, 'f64' AS precision, 'f64' AS whole, 64 + 17 * count(DISTINCT l_quantity) AS bytes FROM lineitem GROUP BY ALL"
)
def wire_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select(
        "l_returnflag", M.to_bytes("digest").alias("blob")
    )
    whole = M.infer_column_precision(blobs, "blob")
    return blobs.select(
        "l_returnflag",
        M.wire_precision("blob").alias("precision"),
        F.lit(whole).alias("whole"),
        F.octet_length("blob").cast("long").alias("bytes"),
    )


@query(sql.quantiles("lineitem", [], "l_quantity", PROBES))
def digest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests as files of bytes, read back and merged."""
    folder = shared_folder(spark, "digests")
    files = write_digest_files(digest_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), folder)
    files.write.parquet(shared_folder(spark, "digest-list"))
    return _rounded(quantiles_by(merge_by(read_digest_files(spark, f"{folder}/*.tdig"), []), PROBES), "value")


@query(sql.quantiles("lineitem", ["l_returnflag"], "l_quantity", [0.25, 0.5, 0.75]))
def in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions in SQL."""
    M.register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("millstone_lineitem")
    return spark.sql(
        "WITH p AS (SELECT l_returnflag, l_quantity, count(*) AS w FROM millstone_lineitem GROUP BY l_returnflag, l_quantity),"
        " d AS (SELECT l_returnflag, tdigest_weighted(CAST(l_quantity AS DOUBLE), CAST(w AS DOUBLE)) AS d FROM p GROUP BY l_returnflag)"
        " SELECT l_returnflag, q, round(tdigest_quantile(d, q), 6) AS value FROM d, (SELECT explode(array(0.25D, 0.5D, 0.75D)) AS q)"
    )


def _file_query(fmt: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, f"values-{fmt}")
        rows = table(spark, sf_dir, "lineitem").select(
            F.col("l_quantity").cast("string").alias("a"), F.col("l_quantity").alias("v")
        )
        if fmt == "text":
            rows.select(F.concat_ws("; ", F.lit("qty"), "a").alias("line")).write.text(folder)
        elif fmt == "csv":
            rows.select(F.lit("x").alias("Other"), F.col("v").alias("Qty")).write.csv(folder, header=True)
        elif fmt == "ndjson":
            rows.select("v").write.json(folder)
        else:
            # A list per file: the few distinct quantities with their counts, as one JSON text.
            distinct = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
            listed = F.to_json(F.struct(F.flatten(F.collect_list(F.expr("array_repeat(v, int(n))"))).alias("v")))
            distinct.groupBy(F.pmod(F.xxhash64("v"), F.lit(4)).alias("k")).agg(
                listed.alias("line")
            ).select("line").repartition(4).write.text(folder)
        column = {"text": None, "csv": "qty", "ndjson": "v", "json": "v"}[fmt]
        return _rounded(quantiles_by(digest_by(read_values(spark, folder, fmt, column), [], "value"), PROBES), "value")

    run.__name__ = f"source_{fmt}"
    query(sql.quantiles("lineitem", [], "l_quantity", PROBES))(run)


for _fmt in ("text", "csv", "json", "ndjson"):
    _file_query(_fmt)


# --- streams ---------------------------------------------------------------------------


@query(
    "SELECT event_type, count(*) * 1.0::DOUBLE AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type"
)
def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running digests of a replayed stream; the last state of each key."""
    events = table(spark, sf_dir, "events")
    out, mark = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-mark")
    running = running_digests(
        spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"), ["event_type"], "value"
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    running.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(
        availableNow=True
    ).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{out}/batch=*").groupBy("event_type").agg(F.max_by("blob", "batch").alias("blob"))
    d = last.select("event_type", M.from_bytes("blob").alias("digest"))
    return d.select(
        "event_type",
        F.col("digest.count").alias("n"),
        F.col("digest.min").alias("low"),
        F.col("digest.max").alias("high"),
    )


@query(
    "WITH m AS (SELECT max(ts) AS last FROM events), e AS (SELECT date_trunc('day', ts) AS day, event_type, value FROM events)\n"
    "SELECT CAST(day AS TIMESTAMP) AS day, event_type, count(*) * 1.0::DOUBLE AS n, min(value) AS low, max(value) AS high FROM e, m WHERE day + INTERVAL 1 DAY <= last - INTERVAL 1 HOUR GROUP BY ALL"
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of closed days: a streaming histogram with a watermark, made into digests batch by batch."""
    events = table(spark, sf_dir, "events")
    out, mark = shared_folder(spark, "windows-out"), shared_folder(spark, "windows-mark")
    points = windowed_points(
        spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"),
        "ts",
        "1 day",
        ["event_type"],
        "value",
        delay="1 hour",
    )

    def keep(batch: DataFrame, number: int) -> None:
        day = F.to_utc_timestamp("window.start", F.current_timezone()).cast("timestamp_ntz")
        made = digest_by(batch.withColumn("day", day), ["day", "event_type"], "value", "n")
        made.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    points.writeStream.outputMode("append").option("checkpointLocation", mark).trigger(
        availableNow=True
    ).foreachBatch(keep).start().awaitTermination()
    d = spark.read.parquet(f"{out}/batch=*")
    return d.select(
        "day",
        "event_type",
        F.col("digest.count").alias("n"),
        F.col("digest.min").alias("low"),
        F.col("digest.max").alias("high"),
    )


# --- merged copies ---------------------------------------------------------------------


@query(sql.quantiles("region", [], "r_regionkey", [0.1, 0.5, 0.9], weight="4.0"))
def merged_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four copies of a digest, merged: merging is explicit, a row function acts on its row."""
    d = digest_by(table(spark, sf_dir, "region"), [], "r_regionkey")
    copies = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return _rounded(quantiles_by(merge_by(copies, []), [0.1, 0.5, 0.9]), "value")
