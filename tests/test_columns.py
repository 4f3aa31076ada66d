"""Columns, operators, sources, streams, the command line, and every headline query against its SQL."""

from __future__ import annotations

import io
import math
import sys
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millstone import Digest, DigestError, IncompatibleMerge, InvalidProbe, InvalidScale, InvalidTrainingData
from millstone import functions as M
from millstone.cli import run as cli
from millstone.operators import digest_by, merge_by, quantiles_by
from millstone.plans.queries import ORACLES, QUERIES
from millstone.sources import detect_format, infer_precision, read_digest_files, read_values, write_digest_files
from millstone.streaming import running_digests

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, tables, name):
    got = QUERIES[name](spark, SMALL)
    want = tables.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plainly(got.select(*columns).collect()) == plainly(want.fetchall())


def plainly(rows):
    """Rows as sorted text; decimals as floats."""
    return sorted(repr(tuple(float(x) if isinstance(x, Decimal) else x for x in r)) for r in rows)


def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_partitioning_does_not_matter(spark):
    rows = spark.createDataFrame([(i % 3, float((i * 7919) % 5003)) for i in range(20_000)], "g int, x double")
    made = [sorted(map(repr, digest_by(rows.repartition(n), ["g"], "x").collect())) for n in (1, 3, 17)]
    assert made[0] == made[1] == made[2]
    plain = sorted(map(repr, rows.groupBy("g").agg(M.tdigest("x").alias("digest")).collect()))
    assert plain == made[0]
    local = {g: Digest.from_array([float((i * 7919) % 5003) for i in range(20_000) if i % 3 == g]) for g in range(3)}
    for r in digest_by(rows, ["g"], "x").collect():
        assert Digest.from_row(r.digest, "f64").means == local[r.g].means


@pytest.mark.parametrize("mode", ["hashed", "partial"])
def test_shards_keep_weight_and_accuracy(spark, mode):
    values = np.random.default_rng(4).lognormal(size=30_000)
    d = Digest.collected(digest_by(numbers(spark, values.tolist()).repartition(40), [], "x", mode=mode, shards=600))[0]
    assert d.count == 30_000 and d.sum == pytest.approx(values.sum()) and (d.min, d.max) == (values.min(), values.max())
    for q in (0.01, 0.5, 0.99):
        assert abs((values <= d.quantile(q)).mean() - q) < 3e-3


def test_partial_digests_of_odd_keys(spark, monkeypatch):
    from millstone.operators import build

    rows = spark.createDataFrame(
        [(i % 7 if i % 5 else None, [i % 2], float(i % 11), 1.0 + i % 3) for i in range(5000)],
        "g int, a array<int>, x double, w double",
    )
    want = sorted(map(repr, digest_by(rows, ["g", "a"], "x", "w", mode="histogram").collect()))
    assert sorted(map(repr, digest_by(rows, ["g", "a"], "x", "w", mode="partial", shards=3).collect())) == want
    monkeypatch.setattr(build, "HELD", 100)
    monkeypatch.setattr(build, "PENDING", 20)
    assert sorted(map(repr, digest_by(rows, ["g", "a"], "x", "w", mode="partial", shards=3).collect())) == want
    plan = digest_by(rows, ["g"], "x", mode="partial", shards=3)._jdf.queryExecution().executedPlan().toString()
    # Digests alone are shuffled: dealt by group and salt, then by group.
    assert plan.count("Exchange hashpartitioning") == 2
    with pytest.raises(ValueError, match="mode"):
        digest_by(rows, ["g"], "x", mode="none")


@pytest.mark.parametrize("mode", ["auto", "streamed", "hashed"])
def test_number_of_partitions_does_not_change_digest(spark, mode):
    values = np.random.default_rng(8).random(6000).tolist()
    made = {
        digest_by(numbers(spark, values).repartition(n), [], "x", scale="k1", max_size=100, mode=mode).select(
            M.to_bytes("digest").alias("b")
        ).first().b
        for n in (2, 7, 50)
    }
    assert len(made) == 1
    if mode != "hashed":
        assert made == {Digest.from_array(values, scale="k1", max_size=100).to_bytes()}


def test_the_last_k1_cluster_is_blended_as_any_other(spark, tmp_path):
    """350,000 different prices leave three points to the last cluster before the pinned one; the rule, point by point."""
    n, size = 350_000, 1000
    spark.range(n).select(
        F.lit("A").alias("l_returnflag"), (F.col("id") / 100).alias("l_extendedprice")
    ).write.parquet(f"{tmp_path}/lineitem.parquet")

    def k(q):
        return size / (2 * math.pi) * math.asin(2 * min(max(q, 1e-15), 1 - 1e-15) - 1)

    inner, clusters, start = n - 2, [], 0
    for i in range(1, inner + 1):
        if i == inner or k((i + 1) / inner) - k(start / inner) > 1 + 1e-12:
            clusters.append((start + 1, i + 1))
            start = i
    want = [(0, 1), *clusters, (n - 1, n)]
    assert clusters[-1] == (n - 4, n - 1)
    got = sorted(QUERIES["k1_centroids"](spark, str(tmp_path)).collect(), key=lambda r: r["mean"])
    assert [r["weight"] for r in got] == [b - a for a, b in want]
    assert [r["mean"] for r in got] == pytest.approx([(a + b - 1) / 200 for a, b in want], abs=2e-4)


def test_zeros_of_either_sign_are_one_value(spark):
    assert Digest.collected(digest_by(numbers(spark, [0.0, -0.0, 1.0]), [], "x"))[0].weights == [2, 1]


def test_groups_larger_than_a_part_are_streamed(spark):
    """Half a million distinct values in one group, beside small ones and a null key, from any number of partitions."""
    values = np.random.default_rng(21).lognormal(size=500_000)
    rows = spark.createDataFrame([(float(v),) for v in values[:1000]], "x double")
    many = spark.range(500_000).select((F.rand(5) * 1000 + F.col("id") / 1e6).alias("x"), F.lit("big").alias("g"))
    small = rows.select("x", F.when(F.col("x") > 1, F.lit("small")).alias("g"))
    both = many.unionByName(small).cache()
    made = [digest_by(both.repartition(n), ["g"], "x", mode="streamed", max_size=100).collect() for n in (2, 7)]
    assert sorted(map(repr, made[0])) == sorted(map(repr, made[1]))
    got = {r.g: Digest.from_row(r.digest, "f64") for r in made[0]}
    for g, d in got.items():
        own = [r.x for r in both.where(F.col("g").eqNullSafe(F.lit(g))).collect()]
        want = Digest.from_array(own, max_size=100)
        assert d.weights == want.weights and d.means == pytest.approx(want.means, rel=1e-12)


def test_planning_runs_no_job(spark):
    from millstone.operators import rollup_by

    rows = spark.createDataFrame([(i % 3, i % 2, float(i)) for i in range(100)], "g int, h int, x double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        for mode in ("auto", "streamed", "hashed", "partial"):
            merge_by(digest_by(rows, ["g", "h"], "x", mode=mode), ["g"])
        rollup_by(rows, ["g", "h"], "x")
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merging_blended_digests_is_one_pass(spark):
    """Up to a fan of digests merge at once, however they are dealt; more of them in the same way each time."""
    rows = spark.createDataFrame(
        [(i % 3, i % 40, float((i * 7919) % 10007)) for i in range(12_000)], "g int, h int, x double"
    )
    parts = digest_by(rows, ["g", "h"], "x", max_size=20).cache()
    want = {g: Digest.merge_all(Digest.collected(parts.where(F.col("g") == g))).parts for g in range(3)}
    for n in (1, 7, 50):
        for r in merge_by(parts.repartition(n), ["g"]).collect():
            got = Digest.from_row(r.digest, "f64").parts
            assert got.means.tolist() == want[r.g].means.tolist() and got.weights.tolist() == want[r.g].weights.tolist()


def test_null_and_equal_digests(spark):
    from millstone.operators import build

    d = digest_by(numbers(spark, [0.0, 1.0, 5.0]), [], "x")
    many = spark.range(20_000).join(F.broadcast(d)).withColumn("digest", F.when(F.col("id") % 2 == 0, F.col("digest")))
    one = merge_by(many, []).first().digest
    assert one["count"] == 30_000 and [c["weight"] for c in one["centroids"]] == [10_000] * 3 and one["sum"] == 60_000
    none = many.where("digest is null").select(F.lit(1).alias("g"), "digest")
    assert merge_by(none, ["g"]).first().digest["count"] == 0
    # A group's nulls are dealt to all salts, so none of the tasks has them all.
    plan = build._merged(
        none.withColumnRenamed("digest", "__digest"), ["g"], "f64", "digest"
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id() % 32" in plan or "pmod(monotonically_increasing_id(), 32)" in plan


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_bad_values_stop_the_query(spark, bad):
    rows = numbers(spark, [1.0, bad])
    for made in (digest_by(rows, [], "x"), rows.agg(M.tdigest("x"))):
        with pytest.raises(Exception, match="finite|null"):
            made.collect()


def test_bad_weights_stop_the_query(spark):
    for w in (0.0, -1.0, None, float("nan")):
        rows = spark.createDataFrame([(1.0, 1.0), (2.0, w)], "x double, w double")
        with pytest.raises(Exception, match="weights"):
            digest_by(rows, [], "x", "w").collect()


def test_empty_input(spark):
    none = numbers(spark, []).withColumn("g", F.lit(1))
    assert digest_by(none, ["g"], "x").count() == 0
    row = digest_by(none, [], "x", max_size=50).select(
        "digest",
        M.quantile("digest", 0.5).alias("q"),
        M.cdf("digest", 1.0).alias("c"),
        M.median("digest").alias("m"),
        M.tdigest_summary("digest").alias("s"),
    ).first()
    assert row.digest["max_size"] == 50 and row.q is None and row.m is None and row.s is None and math.isnan(row.c)


def test_null_digests_are_empty(spark):
    d = digest_by(
        spark.createDataFrame([("A", 0.0), ("A", 1.0), ("A", 2.0)], "g string, x double"), ["g"], "x", max_size=10
    )
    joined = spark.createDataFrame([("A",), ("B",)], "g string").join(d, "g", "left")
    got = {
        r.g: r
        for r in merge_by(joined, ["g"]).select(
            "g", M.quantile("digest", 0.5).alias("q"), M.cdf("digest", [-math.inf, 1.0, math.inf]).alias("c")
        ).collect()
    }
    assert got["A"].q == 1.0 and got["A"].c == [0.0, 0.5, 1.0]
    assert got["B"].q is None and all(math.isnan(x) for x in got["B"].c)


def test_groups_with_a_filter(spark):
    rows = spark.createDataFrame([(0, -3.0), (0, -2.0), (1, 15.0), (1, 25.0), (1, 35.0)], "id int, x double")
    kept = rows.select("id").distinct().join(digest_by(rows.where("x > 0"), ["id"], "x", max_size=64), "id", "left")
    got = {
        r.id: r
        for r in merge_by(kept, ["id"]).select(
            "id", M.quantile("digest", 0.5).alias("q"), M.cdf("digest", 25.0).alias("c")
        ).collect()
    }
    assert got[0].q is None and math.isnan(got[0].c) and (got[1].q, got[1].c) == (25.0, 0.5)


def test_literal_arguments_are_checked_when_planned():
    for q in (math.nan, -0.1, 1.1, math.inf):
        with pytest.raises(InvalidProbe):
            M.quantile("d", q)
    with pytest.raises(InvalidProbe):
        M.cdf("d", [1.0, None])
    for f in (0, -1, math.nan, math.inf):
        with pytest.raises(InvalidScale):
            M.scale_values("d", f)
    with pytest.raises(InvalidTrainingData):
        M.add_values("d", [None])
    with pytest.raises(ValueError, match="f32 or f64"):
        M.cast_precision("d", "auto")
    with pytest.raises(ValueError, match="versions"):
        M.to_bytes("d", 7)
    with pytest.raises(DigestError):
        M.tdigest("x", 5)


def test_column_probes(spark):
    d = digest_by(numbers(spark, [0.0, 1.0, 2.0, 3.0]), [], "x")
    rows = d.crossJoin(spark.createDataFrame([(0.5, 2.0, [1.0, 2.0])], "q double, x double, xs array<double>"))
    r = rows.select(
        M.quantile("digest", F.col("q")).alias("q"),
        M.cdf("digest", F.col("x")).alias("c"),
        M.cdf("digest", F.col("xs"), array=True).alias("cs"),
        M.trimmed_mean("digest", 0.0, 1.0).alias("t"),
    ).first()
    assert (r.q, r.c, r.cs, r.t) == (1.5, 0.625, [0.375, 0.625], 1.5)
    with pytest.raises(Exception, match="null"):
        d.select(M.cdf("digest", F.lit(None).cast("double"))).collect()


def test_strict_merge(spark):
    rows = numbers(spark, [1.0, 2.0, 3.0])
    two = digest_by(rows, [], "x", max_size=20).unionAll(digest_by(rows, [], "x", max_size=30))
    with pytest.raises(Exception, match="max_size 20 and 30|max_size 30 and 20"):
        merge_by(two, []).collect()
    assert merge_by(two, [], strict=False).first().digest["count"] == 6
    with pytest.raises(ValueError, match="no digest"):
        merge_by(rows, [], "x")


def test_many_digests_merge_in_fans(spark, monkeypatch):
    from millstone.operators import build, rollup_by

    monkeypatch.setattr(build, "FAN", 3)
    rows = spark.createDataFrame([(i % 2, i % 40, float(i % 13)) for i in range(2000)], "g int, h int, x double")
    parts = digest_by(rows, ["g", "h"], "x")
    want = {r.g: r.digest for r in digest_by(rows, ["g"], "x").collect()}
    assert {r.g: r.digest for r in merge_by(parts, ["g"]).collect()} == want
    whole = merge_by(parts, []).first().digest
    assert whole == digest_by(rows, [], "x").first().digest
    for cube, n in ((False, 40 + 2 + 1), (True, 40 + 2 + 40 + 1)):
        made = rollup_by(rows, ["g", "h"], "x", cube=cube).collect()
        assert len(made) == n and [r.digest for r in made if r.level == 3] == [whole]
        assert {r.g: r.digest for r in made if r.level == 1} == want


def test_rows_with_their_digest(spark):
    from millstone.operators import with_digest

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, x double")
    got = with_digest(rows, ["g"], "x").select("g", "x", F.col("digest.max").alias("m")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1.0, 3.0), ("a", 3.0, 3.0), (None, 5.0, 5.0)], key=str)


def test_f32_columns(spark):
    d = digest_by(numbers(spark, [0.1, 0.2, 0.2]), [], "x", precision="f32")
    assert d.schema["digest"].dataType["min"].dataType.simpleString() == "float"
    r = d.select(
        M.quantile("digest", 0.0).alias("q"),
        M.wire_precision(M.to_bytes("digest")).alias("p"),
        M.from_bytes(M.to_bytes("digest"), "f32").alias("b"),
        F.col("digest"),
    ).first()
    assert r.q == float(np.float32(0.1)) and r.p == "f32" and r.b == r.digest
    with pytest.raises(Exception, match="f32"):
        d.select(M.from_bytes(M.to_bytes("digest"), "f64")).collect()
    merged = merge_by(d.unionAll(d), [])
    assert merged.schema[
        "digest"
    ].dataType["min"].dataType.simpleString() == "float" and merged.first().digest["count"] == 6


def test_scaling_and_casting_keep_the_type(spark):
    d = digest_by(numbers(spark, [0.5, 1.0, 4.0]), [], "x", precision="f32")
    more = d.select(M.scale_values(M.scale_weights("digest", 3, precision="f32"), 2, precision="f32").alias("digest"))
    assert more.schema["digest"].dataType == d.schema["digest"].dataType
    x = more.first().digest
    assert (x["count"], x["sum"], x["min"], x["max"]) == (9, 33, 1, 8)
    assert d.select(M.cast_precision("digest", "f64").alias("digest")).first().digest["max"] == 4
    with pytest.raises(Exception, match="f32"):
        digest_by(numbers(spark, [1e300]), [], "x").select(M.cast_precision("digest", "f32")).collect()


def test_sql_functions(spark):
    names = M.register(spark, 64)
    assert {
        "tdigest", "merge_tdigests", "tdigest_quantile", "tdigest_cdf", "tdigest_trimmed_mean", "tdigest_scale_values"
    } <= set(names)
    numbers(spark, [0.0, 1.0, 2.0, 3.0]).createOrReplaceTempView("millstone_x")
    r = spark.sql(
        "WITH d AS (SELECT tdigest(x) AS d FROM millstone_x), m AS (SELECT merge_tdigests(d) AS d FROM (SELECT d FROM d UNION ALL SELECT d FROM d))"
        " SELECT tdigest_quantile(m.d, 0.5D) AS q, tdigest_cdf(m.d, 2D) AS c, tdigest_median(d.d) AS md, tdigest_trimmed_mean(d.d, 0D, 1D) AS t, d.d.max_size AS k, tdigest_wire_precision(tdigest_to_bytes(d.d)) AS p,"
        " tdigest_scale_values(d.d, 2D).max AS s, tdigest_quantile(tdigest_add_values(d.d, array(9D)), 1D) AS a, tdigest_cdf_array(d.d, array(0D, 9D)) AS cs, tdigest_to_f32(d.d).max AS f FROM d, m"
    ).first()
    assert (r.q, r.c, r.md, r.t, r.k, r.p, r.s, r.a, r.cs, r.f) == (
        1.5, 0.625, 1.5, 1.5, 64, "f64", 6.0, 9.0, [0.125, 1.0], 3.0
    )


def test_blob_columns(spark):
    a, b = Digest.from_array([1, 2]).to_bytes(), Digest.from_array([1, 2], precision="f32").to_bytes()
    blobs = lambda *x: spark.createDataFrame([(bytearray(v) if v is not None else None,) for v in x], "blob binary")
    assert M.infer_column_precision(blobs(a, a, None), "blob") == "f64"
    assert M.infer_column_precision(blobs(b), "blob") == "f32"
    assert M.infer_column_precision(blobs(None), "blob") == "f64"
    assert M.infer_column_precision(blobs(a, b), "blob", strict=False) == "f64"
    with pytest.raises(IncompatibleMerge):
        M.infer_column_precision(blobs(a, b), "blob")
    both = blobs(a, Digest.from_array([5, 6]).to_bytes(2)).select(M.from_bytes("blob").alias("digest"))
    assert merge_by(both, []).first().digest["count"] == 4
    for bad in (blobs(a, None), blobs(b""), blobs(a, b)):
        with pytest.raises(Exception, match="null|too few|not f64"):
            bad.select(M.from_bytes("blob")).collect()


def test_digests_in_parquet(spark, tmp_path):
    digest_by(spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 9.0)], "g int, x double"), ["g"], "x").write.parquet(
        str(tmp_path / "d")
    )
    back = spark.read.parquet(str(tmp_path / "d"))
    assert sorted((r.g, r.value) for r in quantiles_by(back, [1.0]).collect()) == [(1, 2.0), (2, 9.0)]


def test_plan_is_a_histogram_with_pruned_columns(spark):
    d = digest_by(
        spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_discount > 0.05"),
        ["l_returnflag"],
        "l_quantity",
        shards=1,
    )
    plan = d._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)]" in plan
    assert "l_comment" not in plan.split("Physical Plan")[1] and "l_extendedprice" not in plan.split("ReadSchema")[1]


# --- sources ---------------------------------------------------------------------------


def written(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    ("name", "text", "column", "want"),
    [
        ("a.txt", "1, 2;x 3\n\n4e0 nope\t-5", None, [-5, 1, 2, 3, 4]),
        ("a.csv", "X,y\n1,9\n2,9\n\n3\n", "x", [1, 2, 3]),
        ("b.csv", "1,9\n2,8\n", None, [1, 2]),
        ("c.csv", "h,k\n1,9\n2,8\n", 1, [8, 9]),
        ("d.csv", "1,9\n2\n", 1, [9]),
        ("a.json", '[1, "2", 3.5]', None, [1, 2, 3.5]),
        ("b.json", '[{"v": 1}, {"v": "2"}]', "v", [1, 2]),
        ("c.json", '{"v": [0, 1], "w": 3}', "v", [0, 1]),
        ("a.ndjson", '{"v":0}\n{"v":1}\n\n{"v":2}\n{"v":3}\n', "v", [0, 1, 2, 3]),
        ("b.jsonl", "1\n2\n", None, [1, 2]),
    ],
)
def test_readers(spark, tmp_path, name, text, column, want):
    assert sorted(r.value for r in read_values(spark, written(tmp_path / name, text), column=column).collect()) == want


def test_reader_errors(spark, tmp_path):
    for name, text, column in (
        ("a.csv", "x\n1\nbad\n", "x"),
        ("a.json", '[1, "z"]', None),
        ("b.json", '[{"v":1},{"w":2}]', "v"),
        ("a.ndjson", "null\n", None),
    ):
        with pytest.raises(Exception, match="not a number|without a number"):
            read_values(spark, written(tmp_path / name, text), column=column).collect()
    with pytest.raises(ValueError, match="no column"):
        read_values(spark, written(tmp_path / "q.csv", "x\n1\n"), column="y")
    with pytest.raises(ValueError, match="format"):
        read_values(spark, str(tmp_path), "xml")
    assert [detect_format(p) for p in ("a.CSV", "b.json", "c.ndjson", "d.jsonl", "e.txt", "f")] == [
        "csv", "json", "ndjson", "ndjson", "text", "text"
    ]


def test_precision_of_values(spark):
    assert infer_precision(numbers(spark, [0.0, 1.0, 0.1]).toDF("value")) == "f32"
    assert infer_precision(numbers(spark, [1e100, 2e100]).toDF("value")) == "f64"


def test_digest_files(spark, tmp_path):
    d = digest_by(spark.createDataFrame([(1, 1.0), (2, 9.0)], "g int, x double"), ["g"], "x")
    files = write_digest_files(d, str(tmp_path / "out")).collect()
    assert len(files) == 2 and {r.g for r in files} == {1, 2}
    assert merge_by(read_digest_files(spark, str(tmp_path / "out")), []).first().digest["count"] == 2


def test_cli(spark, tmp_path):
    values = written(tmp_path / "v.csv", "x,y\n0,9\n1,9\n2,9\n3,9\n")
    saved = str(tmp_path / "d.tdig")
    with pytest.raises(SystemExit):
        cli(["build", "--input", values, "--column", "x"], spark)
    assert "n=4" in cli(
        ["build", "--input", values, "--column", "x", "--to-digest", saved, "--max-size", "64", "--precision", "f64"],
        spark,
    )
    assert cli(["quantile", "--from-digest", saved, "--p", "0.5"], spark) == "p,value\n0.5,1.5"
    assert cli(["cdf", "--input", values, "--column", "x", "--x", "2.0", "--no-header"], spark) == "2.0,0.625"
    assert cli(["median", "--input", values, "--column", "0", "--output", "text"], spark) == "1.5"
    more = cli(
        [
            "quantile",
            "--from-digest",
            saved,
            "--input",
            values,
            "--column",
            "x",
            "--merge-digest",
            saved,
            "--p",
            "1.0,0.0",
        ],
        spark,
    )
    assert more == "p,value\n1.0,3.0\n0.0,0.0"
    with pytest.raises(InvalidProbe):
        cli(["quantile", "--from-digest", saved, "--p", "1.5"], spark)
    with pytest.raises(SystemExit):
        cli(["median"], spark)
    assert Digest.from_bytes(open(saved, "rb").read()).inner_kind() == "f64"


def test_cli_standard_input_and_probes(spark, tmp_path, monkeypatch):
    def typed(text):
        monkeypatch.setattr(sys, "stdin", io.StringIO(text))

    typed("0 1 2 3")
    assert cli(["median", "--stdin", "--no-header", "--output", "csv"], spark) == "1.5"
    train, probes = written(tmp_path / "t.csv", "x,y\n0,10\n1,11\n2,12\n3,13\n"), written(
        tmp_path / "p.json", "[0,2,3]"
    )
    told = ["cdf", "--input", train, "--input-format", "csv", "--input-column", "x", "--no-header"]
    want = ["0.0,0.125", "2.0,0.625", "3.0,0.875"]
    assert cli([*told, "--probes-input", probes, "--probes-format", "json"], spark).splitlines() == want
    typed("p\n0\n2\n3\n")
    assert cli([*told, "--probes-stdin", "--probes-format", "csv", "--probes-column", "p"], spark).splitlines() == want
    typed('{"v": 0}\n{"v": "2"}\n\n{"v": 3}')
    assert cli(
        [*told, "--probes-stdin", "--probes-format", "ndjson", "--probes-column", "v"], spark
    ).splitlines() == want
    assert sorted(cli(told, spark).splitlines()) == sorted([*want, "1.0,0.375"])
    assert cli([*told, "--x", "0", "--x", "2,3"], spark).splitlines() == want
    saved = str(tmp_path / "s.tdig")
    typed("[0.5, 0.25]")
    cli(
        [
            "build",
            "--stdin",
            "--input-format",
            "json",
            "--precision",
            "auto",
            "--wire-version",
            "v2",
            "--to-digest",
            saved,
        ],
        spark,
    )
    assert Digest.from_bytes(open(saved, "rb").read()).inner_kind() == "f32"
    typed("")
    with pytest.raises(SystemExit):
        cli(["cdf", "--stdin", "--probes-stdin"], spark)


def test_bytes_of_one_precision_in_any_version(spark):
    d = digest_by(spark.createDataFrame([(1, 1.0), (2, 9.0)], "g int, x double"), ["g"], "x", precision="f32")
    two = d.select("g", M.to_bytes("digest", 2).alias("b")).unionAll(d.select("g", M.to_bytes("digest", 3).alias("b")))
    back = two.select("g", M.from_bytes("b", "auto", of=two).alias("digest"))
    assert back.schema["digest"].dataType["min"].dataType.simpleString() == "float"
    assert sorted(r.digest["max"] for r in back.collect()) == [1.0, 1.0, 9.0, 9.0]
    both = two.unionAll(
        digest_by(numbers(spark, [1.0]), [], "x").select(F.lit(0).alias("g"), M.to_bytes("digest").alias("b"))
    )
    with pytest.raises(Exception, match="f32 and f64"):
        M.from_bytes("b", "auto", of=both)
    with pytest.raises(ValueError, match="of="):
        M.from_bytes("b", "auto")


def test_precision_is_carried(spark):
    d = digest_by(numbers(spark, [0.1, 0.2]), [], "x", precision="f32")
    (got,) = Digest.collected(d)
    assert got.inner_kind() == "f32" and got.to_bytes() == d.select(M.to_bytes("digest").alias("b")).first().b
    q = quantiles_by(d, [0.5])
    assert q.schema["value"].dataType.simpleString() == "float" and q.first()["value"] == pytest.approx(0.15)
    assert d.select(M.median("digest", precision="f32").alias("m")).schema["m"].dataType.simpleString() == "float"


def test_one_digest_against_a_column(spark):
    from millstone.operators import cdf_column

    d = digest_by(numbers(spark, [0.0, 1.0, 2.0, 3.0]), [], "x")
    x = spark.createDataFrame([(2.0,), (0.0,), (99.0,)], "v double")
    assert [r.v_cdf for r in cdf_column(x, "v", d).collect()] == [0.625, 0.125, 1.0]
    assert cdf_column(
        x.select(F.col("v").cast("float").alias("v")), "v", d
    ).schema["v_cdf"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="one digest"):
        cdf_column(x, "v", d.unionAll(d))
    assert all(math.isnan(r.v_cdf) for r in cdf_column(x, "v", digest_by(numbers(spark, []), [], "x")).collect())


def test_sliding_frames(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([("a", i, float((i * 7) % 10)) for i in range(30)], "g string, i int, x double")
    w = Window.partitionBy("g").orderBy("i").rowsBetween(-4, 0)
    got = rows.select("i", M.tdigest("x").over(w).alias("d")).select("i", M.quantile("d", 0.5).alias("q")).collect()
    for r in got:
        frame = [float((i * 7) % 10) for i in range(max(0, r.i - 4), r.i + 1)]
        assert r.q == Digest.from_array(frame).quantile(0.5)


def test_running_digests_follow_batches(spark, tmp_path):
    schema, into = "g string, x double", str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("a", float(i)), ("b", 1.0)][: 2 - i % 2], schema).coalesce(1).write.mode(
            "append"
        ).parquet(into)
    seen: list = []
    stream = running_digests(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(into), ["g"], "x", max_size=50
    )
    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).foreachBatch(lambda b, _: seen.extend(b.collect())).start().awaitTermination()
    last = {}
    for r in seen:
        last[r.g] = max(last.get(r.g, (0, None)), (r.n, bytes(r.blob)))
    a = Digest.from_bytes(last["a"][1])
    assert last["a"][0] == 3 and a.means == [0, 1, 2] and a.config.max_size == 50 and last["b"][0] == 2
