"""Best-fit packing into bins of several permitted lengths.

Pieces (texts, or parts of texts longer than the largest length) are packed longest first.
A piece goes to the open bin that it leaves the least room in. Where none holds it, a bin
is opened. For each permitted length that holds the piece, a trial fills such a bin from all that
is left to pack, longest first, and takes its cost, downsized to what it got, per token. The
cheapest length is opened, so the lengths are chosen jointly, by what there is to fill them with: a
long bin is opened only if its saving is not eaten by room that nothing is left for. In the end
each bin is downsized to the smallest permitted length that holds its contents, and costs that.

The cost of a bin of length c is c + ``overhead`` + c * c / (6 * ``width``): a transformer layer of a
width does 24 * width * width operations a token for its matrices and 4 * width * c for attention over
c tokens, so the latter is c / (6 * width) of the former; the overhead is a fixed cost a sequence, in
tokens.

Rows are dealt by a hash of (id, length, copy) into packs of about ``pack_rows`` rows, each
packed alone by one task in bounded memory; only ids and lengths are shuffled. What a pack
loses against packing all at once is its last bins, a few of thousands. Bins are named
(pack, bin).

``write_sequences`` packs texts and writes the packed sequences: a row per bin with its tokens
(byte-level: UTF-8 bytes, and ``END``, which is no byte of UTF-8, after each text), where each piece
begins, and which text it is of. Packs hold about ``PACK_BYTES`` of text there and meet with their texts,
so every text is shuffled once. Rows that may repeat, by a bitmap of repeated ids and hashes, are
grouped and counted first, and each copy is dealt on its own. ``read_pieces`` reads the sequences back.

Every token of every row lies in exactly one bin: longer texts are cut at the largest
length, and their pieces keep ``start``. A row of length 0 has one piece of length 0, in a bin like
any other (a null or empty text has its end token). Null ids and repeated rows take part; equal
rows are told apart by ``copy``, from 0. Other columns are not read, whatever their names. Empty
tables give no rows. A long text is held by the task of its pack, some three times over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from millstone.llm.shared import bitmap_of, column_of, copies_of, in_bitmap, numbered, offsets_of, runs, scratch, stored


LENGTHS = (2048, 8192, 32768)
PACK_ROWS = 20_000


@dataclass(frozen=True)
class Cost:
    """What a sequence of a length costs, in tokens' work without attention."""

    overhead: float = 64.0
    width: int = 4096

    def of(self, length: int) -> float:
        return length + self.overhead + length * length / (6 * self.width)


@dataclass
class Packed:
    """Per piece: its bin and its place in it; per bin: what it holds and its permitted length."""

    bin: np.ndarray
    at: np.ndarray
    used: np.ndarray
    length: np.ndarray


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, cost: Cost = Cost()) -> Packed:
    """Pack pieces none of which is longer than the largest length; ties go by position."""
    permitted = sorted(set(lengths))
    price = {c: cost.of(c) for c in permitted}
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    falling = sizes[order].tolist()
    upto = [0, *np.cumsum(sizes[order]).tolist()]
    where, at = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    for place, i in enumerate(order.tolist()):
        size = falling[place]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = _opened(falling, upto, place, permitted, price), len(used)
            used.append(0)
        where[i], at[i] = b, used[b]
        used[b] += size
        if free > size or size == 0:
            insort(room, (free - size, b))
    held = np.array(used, dtype=np.int64)
    allowed = np.array(permitted, dtype=np.int64)
    return Packed(where, at, held, allowed[np.searchsorted(allowed, held)] if len(held) else held)


def _opened(falling: list[int], upto: list[int], place: int, permitted: list[int], price: dict[int, float]) -> int:
    """The length to open for the piece at ``place`` of the pieces in falling order: the least cost a token of a trial
    filling."""
    best, least = permitted[-1], float("inf")
    for c in permitted:
        if c < falling[place]:
            continue
        got = _filled(falling, upto, place, c)
        a_token = price[next(x for x in permitted if x >= got)] / max(got, 1)
        if a_token < least:
            best, least = c, a_token
    return best


def _filled(falling: list[int], upto: list[int], place: int, room: int) -> int:
    """What a bin takes of the pieces from ``place`` on, longest first: whole runs of them, found by their sums."""
    got, j, n = 0, place, len(falling)
    while j < n and got < room:
        # The longest run from j on that fits, and then the next piece that is short enough.
        stop = bisect_right(upto, upto[j] + room - got, j, n + 1) - 1
        got += upto[stop] - upto[j]
        if stop >= n or falling[-1] > room - got:
            break
        j = bisect_left(falling, got - room, max(stop, j + 1), n, key=neg)
    return got


def packed(
    rows: DataFrame,
    *,
    id_col: str = "doc_id",
    length_col: str = "length",
    lengths: tuple[int, ...] = LENGTHS,
    cost: Cost = Cost(),
    pack_rows: int = PACK_ROWS,
    seed: int = 11,
) -> DataFrame:
    """One row per piece: doc_id, copy, start, n, pack, bin, at (in the bin), bin_used, bin_length.

    ``length_col`` holds a row's number of tokens; null counts as 0, negative is an error.
    """
    longest = max(lengths)
    given = rows.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length")
    )
    packs = given.count() // pack_rows + 1
    dealt = copies_of(given).withColumn(
        "pack", F.pmod(F.xxhash64("doc_id", "length", "copy", F.lit(seed)), F.lit(packs))
    )
    kind = given.schema["doc_id"].dataType.simpleString()

    def flush(pack: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        length = table.column("length").to_numpy()
        if len(length) and length.min() < 0:
            raise ValueError("a negative length")
        pieces = np.maximum(-(-length // longest), 1)
        row = np.repeat(np.arange(len(length)), pieces)
        part = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = part * longest
        n = np.minimum(length[row] - start, longest)
        got = best_fit(n, lengths, cost)
        out = pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(row)),
                "copy": table.column("copy").take(pa.array(row)),
                "start": pa.array(start, pa.int64()),
                "n": pa.array(n, pa.int64()),
                "pack": pa.array(np.full(len(row), pack), pa.int64()),
                "bin": pa.array(got.bin, pa.int64()),
                "at": pa.array(got.at, pa.int64()),
                "bin_used": pa.array(got.used[got.bin], pa.int64()),
                "bin_length": pa.array(got.length[got.bin], pa.int64()),
            }
        )
        yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            packs_here = batch.column("pack").to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(np.diff(packs_here)) + 1, [len(batch)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and int(packs_here[a]) != now:
                    yield from flush(now, held)
                    held = []
                now = int(packs_here[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(now, held)

    schema = f"doc_id {kind}, copy long, start long, n long, pack long, bin long, at long, bin_used long, bin_length long"
    return dealt.repartition("pack").sortWithinPartitions("pack", "length", "doc_id", "copy").mapInArrow(run, schema)


def byte_lengths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, length: tokens of a byte-level model, UTF-8 bytes and one end token; null texts have the end token
    alone."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("length"),
    )


#: The token after each text; the others are the bytes.
END = 0xFF
#: Text of a pack that is written, in expectation; bits of the bitmap of repeated texts at most.
PACK_BYTES, BITMAP_BITS = 16 << 20, 1 << 27
SEQUENCE = "pack long, bin long, bin_length long, bin_used long, tokens binary, at array<long>, start array<long>, n array<long>, copy array<long>"


def write_sequences(
    docs: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: tuple[int, ...] = LENGTHS,
    cost: Cost = Cost(),
    pack_bytes: int = PACK_BYTES,
    seed: int = 11,
) -> DataFrame:
    """Pack all texts and write a row per bin as Parquet in ``folder`` (a new shared one by default): ``SEQUENCE``, and
    the pieces' ids."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sequences")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    texts = texts.withColumns(
        {"h1": F.xxhash64("raw"), "h2": F.xxhash64(F.lit(1), "raw"), "bytes": F.octet_length("raw").cast("long")}
    )
    key = ["doc_id", "h1", "h2", "bytes"]
    counted = stored(texts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "sequence-texts")
    packs = (counted.agg(F.sum(F.col("n") * (F.col("bytes") + 1))).first()[0] or 0) // pack_bytes + 1
    bits = spark.sparkContext.broadcast(
        bitmap_of(counted.where("n > 1").select(F.xxhash64(*key).alias("item")), BITMAP_BITS)
    )

    @arrow_udf("boolean")
    def repeated(names: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, np.asarray(names)))

    marked = texts.withColumn("maybe", repeated(F.xxhash64(*key)))
    single = marked.where(~F.col("maybe")).select(*key, "raw", F.lit(0).cast("long").alias("copy"))
    several = marked.where("maybe").groupBy(*key).agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"))
    dealt = single.unionByName(numbered(several, "n")).withColumn(
        "pack", F.pmod(F.xxhash64(*key, "copy", F.lit(seed)), F.lit(packs))
    )
    schema = spark.createDataFrame([], SEQUENCE).schema.add("doc_id", T.ArrayType(texts.schema["doc_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pack,), table in runs(batches, 1):
            yield from _sequences(pack, table, lengths, cost)

    rows = dealt.select("pack", "raw", "doc_id", "copy", "bytes", "h1", "h2").repartition("pack")
    rows.sortWithinPartitions("pack", "bytes", "doc_id", "h1", "h2", "copy").mapInArrow(run, schema).write.option(
        "compression", "zstd"
    ).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _sequences(pack: int, table: pa.Table, lengths: tuple[int, ...], cost: Cost) -> Iterator[pa.RecordBatch]:
    """The packed sequences of a pack's texts, some at a time."""
    longest = max(lengths)
    raw = column_of(table, "raw")
    begin = offsets_of(raw)
    whole = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(begin) + 1
    pieces = -(-size // longest)
    row = np.repeat(np.arange(len(size)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * longest
    n = np.minimum(size[row] - start, longest)
    got = best_fit(n, lengths, cost)
    order = np.lexsort((got.at, got.bin))
    row, start, n, at, number = row[order], start[order], n[order], got.at[order], got.bin[order]
    first = np.searchsorted(number, np.arange(len(got.used) + 1))
    for a in range(0, len(got.used), 512):
        bins = np.arange(a, min(a + 512, len(got.used)))
        own = slice(int(first[a]), int(first[bins[-1] + 1]))
        base = np.concatenate(([0], np.cumsum(got.used[bins])))
        tokens = np.full(int(base[-1]), END, dtype=np.uint8)
        to = base[number[own] - a] + at[own]
        for i, s, k, t in zip(row[own].tolist(), start[own].tolist(), n[own].tolist(), to.tolist(), strict=True):
            # The end token is the one after a text's last byte, so a piece may be one longer than its bytes.
            piece = whole[begin[i] + s : min(begin[i] + s + k, begin[i + 1])]
            tokens[t : t + len(piece)] = piece
        split = pa.array((first[a : bins[-1] + 2] - first[a]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(split, pa.array(x[own], pa.int64())) for x in (at, start, n)]
        of_row = pa.array(row[own])
        lists += [pa.ListArray.from_arrays(split, column_of(table, c).take(of_row)) for c in ("copy", "doc_id")]
        packed_tokens = pa.Array.from_buffers(
            pa.binary(), len(bins), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(tokens)]
        )
        columns = [
            pa.array(np.full(len(bins), pack)),
            pa.array(bins),
            pa.array(got.length[bins], pa.int64()),
            pa.array(got.used[bins], pa.int64()),
            packed_tokens,
            *lists,
        ]
        yield pa.RecordBatch.from_arrays(
            columns, ["pack", "bin", "bin_length", "bin_used", "tokens", "at", "start", "n", "copy", "doc_id"]
        )


def read_pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece of written sequences: doc_id, copy, start, n, pack, bin, at, bin_used, bin_length, tokens_crc32
    (unsigned, of the piece's tokens)."""
    kind = sequences.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(batch.schema.get_field_index(c)) for c in ("at", "start", "n", "copy", "doc_id")}
            per = np.diff(np.asarray(lists["at"].offsets, dtype=np.int64))
            row = pa.array(np.repeat(np.arange(len(batch)), per))
            flat = {c: x.flatten() for c, x in lists.items()}
            tokens = batch.column(batch.schema.get_field_index("tokens"))
            values = np.frombuffer(tokens.buffers()[2] or b"", dtype=np.uint8)
            begin = np.repeat(offsets_of(tokens)[:-1], per) + np.asarray(flat["at"])
            sums = [
                zlib.crc32(values[a : a + n])
                for a, n in zip(begin.tolist(), np.asarray(flat["n"]).tolist(), strict=True)
            ]
            own = {
                c: batch.column(batch.schema.get_field_index(c)).take(row)
                for c in ("pack", "bin", "bin_used", "bin_length")
            }
            names = ["doc_id", "copy", "start", "n", "pack", "bin", "at", "bin_used", "bin_length"]
            yield pa.RecordBatch.from_arrays(
                [*[{**flat, **own}[c] for c in names], pa.array(sums, pa.int64())], [*names, "tokens_crc32"]
            )

    return sequences.mapInArrow(
        run,
        f"doc_id {kind}, copy long, start long, n long, pack long, bin long, at long, bin_used long, bin_length long, tokens_crc32 long",
    )
