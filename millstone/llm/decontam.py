"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII
characters. Every run of ``n`` consecutive words of a benchmark item is a window; an item
of fewer words, but not none, is one window. The windows' 64-bit hashes are broadcast;
each training text is scanned whole, window by window, and every hash hit is verified on
the words themselves before it counts.

What is broadcast is bounded and checked: items are dealt into slices of at most ``slice_bytes`` of
text. Up to ``at_once`` slices pass in one stage, without a shuffle, and a worker holds no more
than these; of a larger benchmark, the documents pass group after group, and what the earlier
groups hit is written with them in between.

Nulls: a null text has no words. Items with a null id hit like others; all of them together count
as one item and add nothing to the listed ids. An empty benchmark hits nothing, an empty table of
documents gives no rows. Repeated rows are judged one by one. Columns of the input other than the
text are passed on, never read, whatever their names. A long text is scanned by one task, in some
60 bytes of arrays per byte of it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.shared import scratch, stored, trimmed
from millstone.llm.words import ALNUM, Words, windows, words_of

#: Bytes of benchmark text in one broadcast set (windows take some eight times that), and sets that a worker holds.
SLICE_BYTES, AT_ONCE = 8 << 20, 3

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of benchmark items. Per window length: the sorted distinct hashes, where each one's words are, and its
    items.

    Some 40 bytes a window: words are kept once, as the items' joined text.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int) -> None:
        self.ids = [None if item is None else str(item) for item, _ in items]
        texts: list[bytes] = []
        at = 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for words in words_of(pa.array([text for _, text in items], pa.string()), ALNUM):
            for i, row in enumerate(words.rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                if a == b:
                    continue
                k = min(n, b - a)
                hashes = windows(words.hashes[a:b], k)
                lens = words.ends[a:b] - words.starts[a:b]
                stop = np.cumsum(lens + 1) - 1
                begin = stop - lens
                many = len(hashes)
                found[k].append((hashes, at + begin[:many], at + stop[k - 1 :], np.full(many, row)))
                texts.append(words.joined(a, b))
                at += len(texts[-1])
        self.text = b"".join(texts)
        self.by_length = {}
        for k, parts in sorted(found.items()):
            hashes, begin, stop, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((row, hashes))
            hashes, begin, stop, row = hashes[order], begin[order], stop[order], row[order]
            keys, first = np.unique(hashes, return_index=True)
            some = np.zeros(1 << 20, dtype=bool)
            some[keys >> np.uint64(44)] = True
            self.by_length[k] = (keys, np.append(first, len(hashes)), begin, stop, row, some)

    def scan(self, words: Words, hit: np.ndarray, items: list[set[str | None]]) -> None:
        """Mark the words inside occurrences, and add each row's occurring items."""
        for k, (keys, first, begin, stop, owner, some) in self.by_length.items():
            seen = windows(words.hashes, k)
            at = np.flatnonzero(some[seen >> np.uint64(44)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, seen[at]), len(keys) - 1)
            same = keys[place] == seen[at]
            at, place = at[same], place[same]
            row = np.searchsorted(words.first, at, side="right") - 1
            whole = at + k <= words.first[row + 1]
            known: dict[tuple[int, bytes], set[str | None]] = {}
            for j, p, r in zip(at[whole].tolist(), place[whole].tolist(), row[whole].tolist(), strict=True):
                own = words.joined(j, j + k)
                if (p, own) not in known:
                    known[p, own] = {
                        self.ids[owner[e]]
                        for e in range(int(first[p]), int(first[p + 1]))
                        if self.text[begin[e] : stop[e]] == own
                    }
                if known[p, own]:
                    hit[j : j + k] = True
                    items[r] |= known[p, own]


def window_sets(
    benchmark: DataFrame, id_col: str, text_col: str, n: int, slice_bytes: int, at_once: int
) -> Iterator[list]:
    """Groups of at most ``at_once`` broadcasts, one per slice of the benchmark, each of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes) + 1
    if parts > 1:
        # Read once, written by slice; each slice is read alone.
        folder = scratch(spark, "benchmark-slices")
        items.withColumn(
            "slice", F.pmod(F.xxhash64("id", "text"), F.lit(parts))
        ).write.partitionBy("slice").parquet(folder)
        sliced = spark.read.schema(items.schema).parquet(folder)
    for start in range(0, parts, at_once):
        group = []
        for i in range(start, min(start + at_once, parts)):
            some = items if parts == 1 else sliced.where(F.col("slice") == i)
            group.append(
                spark.sparkContext.broadcast(WindowSet([(r[0], r[1]) for r in some.select("id", "text").collect()], n))
            )
        yield group


#: What earlier groups of slices hit in a row: runs of words (first, one past the last, alternating), and items.
MARKS = "array<long>", "array<string>"


def _scanned(
    batch: pa.RecordBatch, place: int, sets: list, marks: int | None
) -> Iterator[tuple[Words, np.ndarray, list[set[str | None]]]]:
    """Words, hits and items of a batch's texts; ``marks`` is the column of earlier hits, which the items follow."""
    for words in words_of(batch.column(place), ALNUM):
        hit = np.zeros(len(words.starts), dtype=bool)
        items: list[set[str | None]] = [set() for _ in words.rows]
        if marks is not None:
            earlier, seen = (
                batch.column(i).slice(words.rows.start, len(words.rows)).to_pylist() for i in (marks, marks + 1)
            )
            for i, spans in enumerate(earlier):
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    hit[int(words.first[i]) + a : int(words.first[i]) + b] = True
                items[i] |= set(seen[i])
        for s in sets:
            s.value.scan(words, hit, items)
        yield words, hit, items


def _spans(hit: np.ndarray) -> np.ndarray:
    """First and one past the last place of each run of hit words, alternating."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))


def _passed(
    docs: DataFrame,
    text_col: str,
    benchmark: DataFrame,
    item_col: str,
    item_text_col: str,
    n: int,
    slice_bytes: int,
    at_once: int,
) -> tuple[DataFrame, list, int | None]:
    """(documents, the last group of slices, the place of marks): all groups but the last have passed, and left their
    marks in two more columns."""
    text = docs.columns.index(text_col)
    marks: int | None = None
    width = len(docs.columns)
    last: list = []
    for group in window_sets(benchmark, item_col, item_text_col, n, slice_bytes, at_once):
        if last:
            docs, marks = stored(_marked(docs, text, last, marks, width), "benchmark-marks"), width
        last = group
    return docs, last, marks


def _marked(docs: DataFrame, text: int, sets: list, marks: int | None, width: int) -> DataFrame:
    """``docs`` with its marks after these sets."""
    free = "mark" + "_" * max(map(len, docs.columns))
    names = docs.columns[:width] + (docs.columns[width:] or [f"{free}words", f"{free}items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, hit, items in _scanned(batch, text, sets, marks):
                spans = [
                    _spans(hit[a:b]).tolist()
                    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)
                ]
                own = batch.slice(words.rows.start, len(words.rows)).columns[:width]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(spans, pa.list_(pa.int64())),
                        pa.array([list(x) for x in items], pa.list_(pa.string())),
                    ],
                    names,
                )

    given = docs.select(*docs.columns[:width])
    schema = given.withColumns(
        {names[width]: F.lit(None).cast(MARKS[0]), names[width + 1]: F.lit(None).cast(MARKS[1])}
    ).schema
    return docs.mapInArrow(trimmed(run), schema)


def _counts(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_words = np.diff(words.first)
    run = np.concatenate(([0], np.cumsum(hit)))
    return n_words, run[words.first[1:]] - run[words.first[:-1]]


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    share: int = 20,
    slice_bytes: int = SLICE_BYTES,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One row per document: its id and ``RESULT``. Contaminated: hit words, and ``share`` times them at least all
    words."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    given, sets, marks = _passed(given, "text", benchmark, item_col, item_text_col, n, slice_bytes, at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, hit, items in _scanned(batch, 1, sets, marks):
                n_words, n_hit = _counts(words, hit)
                listed = [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.rows.start, len(words.rows)),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array(listed, pa.string()),
                        pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return given.mapInArrow(trimmed(run), f"doc_id {kind}, {RESULT}")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    share: int = 20,
    slice_bytes: int = SLICE_BYTES,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """``docs`` without contaminated rows; from the others every hit span is cut.

    All columns stay as they are, but for the text of rows that lose a span (and ``n_chars``,
    where there is such a column, which follows the new text). Rows without a hit, null and
    empty texts included, pass unchanged.
    """
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)
    chars = names.index("n_chars") if "n_chars" in names else None
    docs, sets, marks = _passed(docs, text_col, benchmark, item_col, item_text_col, n, slice_bytes, at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            for words, hit, _ in _scanned(batch, place, sets, marks):
                n_words, n_hit = _counts(words, hit)
                own = batch.slice(words.rows.start, len(words.rows))
                part = pa.RecordBatch.from_arrays(
                    own.columns[: len(names)], schema=pa.schema([own.schema.field(i) for i in range(len(names))])
                )
                cut = {}
                for i in np.flatnonzero((n_hit > 0) & (share * n_hit < n_words)).tolist():
                    raw = column[words.rows.start + i].as_py().encode()
                    a, b, base = int(words.first[i]), int(words.first[i + 1]), int(words.texts[i])
                    cut[i] = _without(raw, words.starts[a:b] - base, words.ends[a:b] - base, hit[a:b])
                if cut:
                    texts = part.column(place).to_pylist()
                    for i, text in cut.items():
                        texts[i] = text
                    part = part.set_column(
                        place, part.schema.field(place), pa.array(texts, part.schema.field(place).type)
                    )
                    if chars is not None:
                        counts = part.column(chars).to_pylist()
                        for i, text in cut.items():
                            counts[i] = len(text)
                        part = part.set_column(
                            chars, part.schema.field(chars), pa.array(counts, part.schema.field(chars).type)
                        )
                kept = pa.array((n_hit == 0) | (share * n_hit < n_words))
                yield part.filter(kept)

    return docs.mapInArrow(trimmed(run), schema)


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each run of hit words."""
    edge = _spans(hit)
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()
