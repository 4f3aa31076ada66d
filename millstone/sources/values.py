"""Numbers from text, CSV, JSON and line-delimited JSON, as one column ``value``.

Everything is read by Spark's own readers from any store that Spark can open, and parsed in
generated code. Text may hold anything between numbers; such tokens are left out. In the
other formats a value that is no number stops the query.

A JSON file is one text: one task parses it whole, so a file must fit an executor's memory (2 GB
at most). Larger input belongs in line-delimited JSON, which is split by lines.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings by format.
ENDINGS = {".csv": "csv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".txt": "text"}

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def detect_format(path: str) -> str:
    """The format that a path's ending tells; text where it tells none."""
    name = path.rstrip("/").lower()
    return next((fmt for end, fmt in ENDINGS.items() if name.endswith(end)), "text")


def _strict(text: Column, what: str) -> Column:
    """A number's text as a double; anything else is an error, null stays."""
    number = text.try_cast("double")
    return F.when(
        text.isNotNull() & number.isNull(),
        F.raise_error(F.concat(F.lit(f"{what}: not a number: "), text)).cast("double"),
    ).otherwise(number)


def read_values(spark: SparkSession, path: str, fmt: str | None = None, column: str | int | None = None) -> DataFrame:
    """The numbers of a file or folder. ``column``: a name (any case) or a place from 0 in CSV, a field in JSON."""
    fmt = detect_format(path) if fmt in (None, "auto") else fmt
    if fmt == "text":
        return _tokens(spark.read.text(path))
    if fmt == "csv":
        return _csv(spark, path, 0 if column is None else column)
    if fmt == "json":
        return _items(spark.read.text(path, wholetext=True).select(F.trim("value").alias("item")), column)
    if fmt == "ndjson":
        lines = spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''")
        return _field(lines, column)
    raise ValueError(f"a format is text, csv, json or ndjson; got {fmt!r}")


def values_of_text(
    spark: SparkSession, text: str, fmt: str | None = None, column: str | int | None = None
) -> DataFrame:
    """The numbers of a text that the driver holds (standard input), in any of the formats; text by default."""
    fmt = "text" if fmt in (None, "auto") else fmt
    if fmt == "csv":
        rows = [r for r in csv.reader(io.StringIO(text)) if r]
        wide = max(map(len, rows), default=0)
        if not wide:
            return spark.createDataFrame([], "value double")
        schema = ", ".join(f"_c{i} string" for i in range(wide))
        place, header = _place(rows[0], 0 if column is None else column)
        cells = spark.createDataFrame([tuple(r + [None] * (wide - len(r))) for r in rows[header:]], schema)
        return _cells(cells, place)
    lines = spark.createDataFrame([(x,) for x in ([text] if fmt == "json" else text.splitlines())], "value string")
    if fmt == "text":
        return _tokens(lines)
    items = lines.select(F.trim("value").alias("item"))
    if fmt == "json":
        return _items(items, column)
    if fmt == "ndjson":
        return _field(items.where("item <> ''"), column)
    raise ValueError(f"a format is text, csv, json or ndjson; got {fmt!r}")


def _tokens(lines: DataFrame) -> DataFrame:
    tokens = lines.select(F.explode(F.split("value", r"[\s,;]+")).alias("token"))
    return tokens.select(F.expr("try_cast(token AS DOUBLE)").alias("value")).where(F.col("value").isNotNull())


def _place(first: Sequence[str | None], column: str | int) -> tuple[int, bool]:
    """A column's place, and whether the first row is a header: always for a name, for a place if its cell is no
    number."""
    if isinstance(column, int) or str(column).isdigit():
        place = int(column)
        if place >= len(first):
            raise ValueError(f"the file has {len(first)} columns; there is no column {place}")
        return place, first[place] is not None and re.match(NUMBER, str(first[place])) is None
    names = [str(x).strip().lower() for x in first]
    if str(column).strip().lower() not in names:
        raise ValueError(f"no column {column!r}; the file has {', '.join(names)}")
    return names.index(str(column).strip().lower()), True


def _cells(rows: DataFrame, place: int) -> DataFrame:
    cell = F.col(rows.columns[place])
    return rows.where(cell.isNotNull()).select(_strict(F.trim(cell), "csv").alias("value"))


def _csv(spark: SparkSession, path: str, column: str | int) -> DataFrame:
    raw = spark.read.csv(path, header=False, mode="PERMISSIVE", enforceSchema=True)
    first = raw.first()
    if first is None:
        return spark.createDataFrame([], "value double")
    place, header = _place(list(first), column)
    return _cells(spark.read.csv(path, header=True, schema=raw.schema, enforceSchema=True) if header else raw, place)


def _items(texts: DataFrame, column: str | int | None) -> DataFrame:
    """Items of whole JSON texts: a list, or an object whose field holds a list or a number."""
    inner = texts if column is None else texts.select(
        F.when(F.col("item").startswith("{"), F.get_json_object("item", f"$.{column}")).otherwise(
            F.col("item")
        ).alias("item")
    )
    listed = F.when(F.col("item").startswith("["), F.from_json("item", "array<string>")).otherwise(F.array("item"))
    return _field(inner.select(F.explode(listed).alias("item")), column)


def _field(items: DataFrame, column: str | int | None) -> DataFrame:
    """Numbers, numbers in quotes, or a field of objects."""
    item = F.col("item")
    if column is not None:
        item = F.when(item.startswith("{"), F.get_json_object("item", f"$.{column}")).otherwise(item)
    bad = F.raise_error(F.lit("json: an item without a number")).cast("double")
    bare = F.regexp_replace(item, r'^"(.*)"$', "$1")
    return items.select(F.when(item.isNull() | (item == "null"), bad).otherwise(_strict(bare, "json")).alias("value"))


def infer_precision(values: DataFrame, column: str = "value") -> str:
    """f32 where every value, as a float, is within 1e-6 of itself or of its size; else f64."""
    x = F.col(column).cast("double")
    as_float = x.cast("float").cast("double")
    near = (F.abs(as_float) < float("inf")) & (F.abs(as_float - x) <= 1e-6 * F.greatest(F.abs(x), F.lit(1.0)))
    row = values.agg(F.bool_and(near).alias("all")).first()
    return "f32" if row["all"] else "f64"
