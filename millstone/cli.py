"""Command line: build, quantile, cdf and median of values in files or on standard input.

    python -m millstone.cli quantile --input values.csv --input-column x --p 0.5,0.9

``cdf`` takes its probes from ``--x``, standard input, a file, or else from the training values.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone import kernel, wire
from millstone.config import InvalidProbe, InvalidTrainingData, config, probability
from millstone.digest import Digest
from millstone.operators import digest_by
from millstone.sources import infer_precision, read_values
from millstone.sources.digests import store_of
from millstone.sources.values import values_of_text

FORMATS = ("auto", "text", "csv", "json", "ndjson")


def _version(said: str) -> int:
    """A wire version: 1 to 3, with or without a v."""
    name = said.lower().removeprefix("v")
    if name not in ("1", "2", "3"):
        raise argparse.ArgumentTypeError(f"a wire version is v1, v2 or v3; got {said!r}")
    return int(name)


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millstone", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("build", "quantile", "cdf", "median"):
        p = commands.add_parser(name)
        source = p.add_mutually_exclusive_group()
        source.add_argument("--stdin", action="store_true", help="train on the values of standard input")
        source.add_argument("--input", help="values to train on; any store that Spark can read")
        p.add_argument("--input-format", "--format", default="auto", choices=FORMATS)
        p.add_argument("--input-column", "--column", help="name or place of a CSV column, or a JSON field")
        p.add_argument("--from-digest", help="a digest file to begin with")
        p.add_argument("--merge-digest", action="append", default=[], help="a digest file to merge; may be given again")
        p.add_argument("--to-digest", required=name == "build", help="where to save the digest")
        p.add_argument("--wire-version", "--digest-version", type=_version, default=wire.LATEST)
        p.add_argument("--max-size", type=int)
        p.add_argument("--scale")
        p.add_argument("--singleton-policy")
        p.add_argument("--pin-per-side", type=int)
        p.add_argument("--delta", type=float)
        p.add_argument("--precision", default="f64", choices=("auto", "f32", "f64"))
        if name == "build":
            continue
        p.add_argument("--output", default="csv", choices=("csv", "text"))
        p.add_argument("--no-header", action="store_true")
        if name == "quantile":
            p.add_argument(
                "--p", action="append", required=True, help="shares from 0 to 1, with commas; may be given again"
            )
        if name == "cdf":
            p.add_argument("--x", action="append", help="values, with commas; may be given again")
            probes = p.add_mutually_exclusive_group()
            probes.add_argument("--probes-stdin", action="store_true", help="read the values from standard input")
            probes.add_argument("--probes-input", help="read the values from a file")
            p.add_argument("--probes-format", default="auto", choices=FORMATS)
            p.add_argument("--probes-column")
    return out


def _column(said: str | None) -> str | int | None:
    return int(said) if said and said.isdigit() else said


def _training(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The values to train on, if any are given."""
    if args.stdin:
        return values_of_text(spark, sys.stdin.read(), args.input_format, _column(args.input_column))
    return read_values(spark, args.input, args.input_format, _column(args.input_column)) if args.input else None


def _numbers(said: list[str], what: str) -> list[float]:
    try:
        return [float(x) for part in said for x in part.split(",")]
    except ValueError as e:
        raise InvalidProbe(f"{what} must be a number: {e}") from None


def _probes(spark: SparkSession, args: argparse.Namespace, training: DataFrame | None) -> list[float]:
    """Where a cdf is asked for; a line is printed for each, so they are few."""
    if args.x:
        return _numbers(args.x, "x")
    if args.probes_stdin:
        found = values_of_text(spark, sys.stdin.read(), args.probes_format, _column(args.probes_column))
    elif args.probes_input:
        found = read_values(spark, args.probes_input, args.probes_format, _column(args.probes_column))
    elif training is not None:
        found = training
    else:
        return []
    return [r.value for r in found.collect()]


def _load(path: str) -> kernel.Parts:
    fs, name = store_of(path)
    with fs.open_input_file(name) as f:
        return wire.decode(f.read())


def _digest(args: argparse.Namespace, values: DataFrame | None) -> Digest:
    """From a digest file, the values, or both; then all digests to merge."""
    settings = {
        "scale": args.scale,
        "singleton_policy": args.singleton_policy,
        "pin_per_side": args.pin_per_side,
        "delta": args.delta,
    }
    out = Digest(_load(args.from_digest)) if args.from_digest else None
    if values is not None:
        if values.where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).limit(1).count():
            raise InvalidTrainingData("values must be finite")
        precision = args.precision
        if out is not None:
            settings, precision, size = {
                "scale": out.config.scale,
                "singleton_policy": out.config.policy,
                "pin_per_side": out.config.pin_per_side or None,
            }, out.inner_kind(), out.config.max_size
        else:
            size = args.max_size
            precision = infer_precision(values) if precision == "auto" else precision
        cfg = config(size, precision=precision, **settings)
        trained = Digest.collected(digest_by(values, [], "value", max_size=size, precision=precision, **settings))[0]
        trained = Digest(
            kernel.Parts(*[getattr(trained.parts, n) for n in ("means", "weights", "atomic", "sum", "min", "max")], cfg)
        )
        out = trained if out is None else out.merge(trained)
    elif out is None and not args.merge_digest:
        raise SystemExit("give --stdin, --input, --from-digest or --merge-digest")
    for path in args.merge_digest:
        other = Digest(_load(path))
        out = other if out is None else out.merge(other)
    return out


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """What the command prints."""
    args = _parser().parse_args(argv)
    if args.command == "cdf" and args.stdin and args.probes_stdin:
        raise SystemExit("standard input holds training values or probes, not both")
    if args.command == "quantile":
        probes = [probability(x) for x in _numbers(args.p, "p")]
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    training = _training(spark, args)
    if args.command == "cdf":
        probes = _probes(spark, args, training)
    digest = _digest(args, training)
    if args.to_digest:
        fs, name = store_of(args.to_digest)
        with fs.open_output_stream(name, compression=None) as f:
            f.write(digest.to_bytes(args.wire_version))
    if args.command == "build":
        return digest.summary() or "empty digest"
    if args.command == "median":
        head, rows = "value", [(digest.median(),)]
    elif args.command == "quantile":
        head, rows = "p,value", list(zip(probes, digest.quantile(probes), strict=True))
    else:
        head, rows = "x,p", list(zip(probes, digest.cdf(probes), strict=True))
    between = "," if args.output == "csv" else "\t"
    lines = [between.join(f"{x!r}" for x in row) for row in rows]
    return "\n".join(lines if args.no_header or args.output == "text" else [head, *lines])


if __name__ == "__main__":
    print(run(sys.argv[1:]))
