"""n-gram Jaccard join of documents by signature trees.

A document's set holds the 64-bit hashes of its distinct runs of ``k`` words (words are what
lies between ASCII white space, A-Z lower-cased); with fewer words the whole sequence is one
element; without words the set is empty and links with nothing. Two documents link when
100 * |intersection| >= percent * |union|. Nothing about a link is estimated.

1. One pass over the texts writes, per row, a 128-bit name of its set, and the elements that may
   have to be counted. Equal sets are one class, named by its place in a written table; from here
   on only classes are compared.
2. Classes that could link share an element among the first |set| - ceil(0.8 |set|) + 1 of
   any one global order of elements (prefix filter: no link is lost). The order is: elements
   with a hash in the lowest third, by the number of sets that hold them, then the others by
   hash. So only that third is counted, with a combination before the shuffle; of what one set alone
   holds nothing else is shuffled, as a bitmap of shared elements (16 MiB at most) keeps it back; and
   passages that many documents share come last. Sharing is recorded as stars, never as pairs, and
   connected components of it are the groups in which every link lies.
3. A group within the bounds of a block is one task, and several small ones share a task. A larger
   group is dealt into blocks by size level and by the smallest element, which sets that link mostly
   share. Blocks are the upper nodes of the trees: each has the OR of its sets' bitmaps and its
   range of sizes. A block's sets, as leaves, are held against the upper nodes of other blocks of
   fitting sizes, and go on to a block only if their elements in its bitmap are enough for a link with
   a set of its sizes; the sets of two blocks never meet otherwise.
4. Within a block, signature trees: a leaf's signature is the bitmap of its
   elements, an inner node holds the OR of its children's bitmaps, the range of set sizes
   and the largest excess of elements over bits. A dual traversal of both trees drops node
   pairs whose largest possible overlap, popcount(AND) + the smaller excess, is below what
   the smallest sizes need. Pairs of leaves are verified on the elements themselves; where
   links need not be counted, not if earlier links connect them already. A block's result
   is stars and a count per row, so copies and clusters stay linear in rows.
5. Components of the links; a row's component is the smallest id of its component's rows.

Nulls: a null text has an empty set; rows with a null id take part and are never a
component's name unless all its rows have none. Repeated rows are one class. Empty tables
give empty results. Other columns are not read, whatever their names. A long text is one set, made
by one task in some 60 bytes of arrays per byte of it, and held with its block in eight bytes an element.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.components import components
from millstone.llm.shared import bitmap_of, column_of, in_bitmap, offsets_of, runs, stored, trimmed
from millstone.llm.words import NOT_SPACE, Words, mixed, windows, words_of

#: Bits of the bitmap of classes to be read again, at most (16 MiB); fewer classes have a smaller one.
BITMAP_BITS = 1 << 27
#: Elements below this hash are counted; others come after them in the order.
COUNTED = (1 << 64) // 3
#: Elements and rows of a block at most, in expectation.
BLOCK_ELEMENTS, BLOCK_ROWS = 1 << 18, 1024
#: Bits of a block's bitmap: twice its elements, so that less than half of them are set.
NODE_BITS = 1 << 19
FANOUT = 8


@dataclass
class Sets:
    """Element sets of a run of rows: ``items`` sorted and distinct within each row, ``first`` where each row begins."""

    items: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit name of each row's set, as two longs; 0 where it is empty."""
        n = self.sizes
        full = np.flatnonzero(n)
        out = np.zeros((2, len(n)), dtype=np.uint64)
        if len(full):
            for half, salt in zip(out, (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)), strict=True):
                total = np.add.reduceat(mixed(self.items ^ salt), self.first[:-1][full])
                half[full] = mixed(total + n[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return out[0].view(np.int64), out[1].view(np.int64)

    def packed(self, rows: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The bytes of the first ``stop`` elements of some rows."""
        raw = self.items.tobytes()
        begin = 8 * self.first[rows]
        return pa.array([raw[a : a + 8 * n] for a, n in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())


def sets_of(words: Words, k: int) -> Sets:
    """The distinct ``k``-word elements of each row."""
    first = words.first
    n_words = np.diff(first)
    elements = windows(words.hashes, k)
    n_rows = len(n_words)
    sizes = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    items = np.empty(at[-1], dtype=np.uint64)
    for a, n, to in zip(first[:-1].tolist(), n_words.tolist(), at[:-1].tolist(), strict=True):
        if n >= k:
            own = items[to : to + n - k + 1]
            own[:] = elements[a : a + n - k + 1]
            own.sort()
        elif n:
            items[to] = windows(words.hashes[a : a + n], n)[0]
    rows = np.repeat(np.arange(n_rows), sizes)
    new = np.ones(len(items), dtype=bool)
    new[1:] = (items[1:] != items[:-1]) | (rows[1:] != rows[:-1])
    return Sets(items[new], np.concatenate(([0], np.cumsum(np.bincount(rows[new], minlength=n_rows)))))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set of which a linked set must hold one: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def counted_run(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, need) of each row: how many of its first elements are counted, or may be in its prefix beyond these.

    ``need`` is the prefix's length less the number of counted elements; with ``q`` of these held by
    other sets as well, the prefix has the ``need + q`` least frequent of them (if that is positive).
    """
    n = sets.sizes
    row = np.repeat(np.arange(len(n)), n)
    counted = np.bincount(row[sets.items < np.uint64(COUNTED)], minlength=len(n))
    need = np.where(n > 0, prefix_length(n, percent), 0) - counted
    # Items are sorted, so the counted ones and the first beyond them are a run from the start.
    return np.minimum(counted + np.maximum(need, 0), n), need


# --- signature trees -------------------------------------------------------------------


@dataclass
class Tree:
    """Levels from the leaves up. Each level: OR-combined bitmaps, size range, least excess of children kept as the
    largest."""

    order: np.ndarray
    bitmaps: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    excess: list[np.ndarray]

    @property
    def height(self) -> int:
        return len(self.bitmaps) - 1


def signatures(sets: Sets, bits: int) -> np.ndarray:
    """The bitmap of every row's elements."""
    n = len(sets.first) - 1
    out = np.zeros(n * (bits // 64), dtype=np.uint64)
    row = np.repeat(np.arange(n), sets.sizes)
    bit = (sets.items >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)
    at = np.unique(row * bits + bit)
    word = at >> 6
    begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(
        0, dtype=np.int64
    )
    if len(word):
        out[word[begin]] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin)
    return out.reshape(n, bits // 64)


def tree_of(sets: Sets, rows: np.ndarray, bits: int) -> Tree:
    """A tree over the given rows, neighbours by their smallest element (similar sets tend to share it)."""
    n = sets.sizes[rows]
    order = rows[np.lexsort((n, sets.items[sets.first[:-1][rows]]))]
    flat = np.concatenate([sets.items[sets.first[r] : sets.first[r + 1]] for r in order])
    own = Sets(flat, np.concatenate(([0], np.cumsum(sets.sizes[order]))))
    bitmap = signatures(own, bits)
    size = own.sizes
    over = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
    tree = Tree(order, [bitmap], [size], [size], [over])
    while len(tree.bitmaps[-1]) > 1:
        at = np.arange(0, len(tree.bitmaps[-1]), FANOUT)
        tree.bitmaps.append(np.bitwise_or.reduceat(tree.bitmaps[-1], at, axis=0))
        tree.low.append(np.minimum.reduceat(tree.low[-1], at))
        tree.high.append(np.maximum.reduceat(tree.high[-1], at))
        tree.excess.append(np.maximum.reduceat(tree.excess[-1], at))
    return tree


def possible(x: Tree, i: np.ndarray, y: Tree, j: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Whether any two sets below nodes i of x and j of y could link, by sizes and by the largest possible overlap."""
    lx, hx, ly, hy = x.low[level][i], x.high[level][i], y.low[level][j], y.high[level][j]
    keep = (100 * hx >= percent * ly) & (100 * hy >= percent * lx)
    at = np.flatnonzero(keep)
    for a in range(0, len(at), 8192):
        some = at[a : a + 8192]
        shared = np.bitwise_count(x.bitmaps[level][i[some]] & y.bitmaps[level][j[some]]).sum(axis=1).astype(np.int64)
        most = np.minimum(
            shared + np.minimum(x.excess[level][i[some]], y.excess[level][j[some]]), np.minimum(hx[some], hy[some])
        )
        # overlap >= percent / (100 + percent) * (sum of sizes), for the smallest sizes below both nodes
        keep[some] = (100 + percent) * most >= percent * (lx[some] + ly[some])
    return keep


class Links:
    """Connected rows of a pair of blocks; verified links merge labels.

    With weights every link is counted, weighted by the row at its other end; without, pairs that
    earlier links connect are not compared.
    """

    def __init__(self, sets: Sets, percent: int, weight: np.ndarray | None = None) -> None:
        self.sets, self.percent, self.weight = sets, percent, weight
        self.links = np.zeros(len(sets.first) - 1, dtype=np.int64)
        self.label = np.arange(len(sets.first) - 1)
        names, self.local = np.unique(sets.items, return_inverse=True)
        self.mark = np.zeros(len(names), dtype=bool)

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the rows of each pair whose sets link, one left row at a time."""
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        at = np.concatenate((np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), [len(a)])) if len(a) else [0]
        first, size = self.sets.first, self.sets.sizes
        for s, e in zip(at[:-1], at[1:], strict=True):
            row, others = int(a[s]), b[s:e]
            if self.weight is None:
                others = others[self.label[others] != self.label[row]]
            if not len(others):
                continue
            own = self.local[first[row] : first[row + 1]]
            self.mark[own] = True
            for c in range(0, len(others), 1024):
                some = others[c : c + 1024]
                if self.weight is None:
                    some = some[self.label[some] != self.label[row]]
                if not len(some):
                    continue
                n = size[some]
                ends = np.cumsum(n)
                flat = self.local[np.arange(ends[-1]) + np.repeat(first[some] - (ends - n), n)]
                both = np.add.reduceat(self.mark[flat].astype(np.int64), ends - n)
                linked = some[100 * both >= self.percent * (size[row] + n - both)]
                if len(linked) and self.weight is not None:
                    self.links[row] += self.weight[linked].sum()
                    self.links[linked] += self.weight[row]
                linked = linked[self.label[linked] != self.label[row]]
                if len(linked):
                    found = np.unique(np.append(self.label[linked], self.label[row]))
                    self.label[np.isin(self.label, found)] = found[0]
            self.mark[own] = False


def tree_join(
    sets: Sets, left: np.ndarray, right: np.ndarray | None, percent: int, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(labels, links) of all rows: labels are equal for rows that links connect; links are counted if there are
    weights.

    ``right`` None: the left rows with each other.
    """
    links = Links(sets, percent, weight)
    rows = left if right is None else np.concatenate([left, right])
    if not len(left) or len(rows) < 2 or (right is not None and not len(right)):
        return links.label, links.links
    bits = 1 << int(np.clip(8 * int(sets.sizes[rows].max()), 256, 1 << 16) - 1).bit_length()
    bits = min(bits, 1 << 16)
    x = tree_of(sets, left, bits)
    y = x if right is None else tree_of(sets, right, bits)
    level = min(x.height, y.height)
    i, j = (
        g.ravel()
        for g in np.meshgrid(np.arange(len(x.bitmaps[level])), np.arange(len(y.bitmaps[level])), indexing="ij")
    )
    if right is None:
        i, j = i[i <= j], j[i <= j]
    todo = [(level, i, j)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > 2048:
            todo += [(level, i[a : a + 2048], j[a : a + 2048]) for a in range(0, len(i), 2048)][::-1]
            continue
        if level == 0 and weight is None:
            a, b = x.order[i], y.order[j]
            apart = links.label[a] != links.label[b]
            i, j = i[apart], j[apart]
        keep = possible(x, i, y, j, level, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            links.verify(x.order[i], y.order[j])
            continue
        step = np.arange(FANOUT)
        ci = (i[:, None, None] * FANOUT + step[:, None]).repeat(FANOUT, axis=2).ravel()
        cj = (j[:, None, None] * FANOUT + step[None, :]).repeat(FANOUT, axis=1).ravel()
        real = (ci < len(x.bitmaps[level - 1])) & (cj < len(y.bitmaps[level - 1]))
        if right is None:
            real &= ci < cj if level == 1 else ci <= cj
        todo.append((level - 1, ci[real], cj[real]))
    return links.label, links.links


# --- the distributed join --------------------------------------------------------------


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _rows(given: DataFrame, k: int, percent: int) -> DataFrame:
    """Of every row: doc_id, text_name, h1, h2 (its set's name), n, low (the smallest element), need, run (the counted
    elements, once per set that a task meets)."""
    kind = given.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_name", "h1", "h2", "n", "low", "need", "fresh", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for words in words_of(batch.column(1), NOT_SPACE):
                sets = sets_of(words, k)
                h1, h2 = sets.names()
                fresh = _fresh(h1, h2, done, np.flatnonzero(sets.sizes))
                stop, need = counted_run(sets, percent)
                low = np.zeros(len(h1), dtype=np.int64)
                full = np.flatnonzero(sets.sizes)
                low[full] = sets.items[sets.first[:-1][full]].view(np.int64)
                where = np.full(len(h1), -1)
                where[fresh] = np.arange(len(fresh))
                runs_of = sets.packed(fresh, stop[fresh]).take(pa.array(where, mask=where < 0))
                own = [batch.column(i).slice(words.rows.start, len(words.rows)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(h1),
                        pa.array(h2),
                        pa.array(sets.sizes, pa.int64()),
                        pa.array(low),
                        pa.array(need, pa.int32()),
                        pa.array(where >= 0),
                        runs_of,
                    ],
                    names,
                )

    named = given.select("doc_id", "text", F.xxhash64("text").alias("text_name"))
    return named.mapInArrow(
        trimmed(run), f"doc_id {kind}, text_name long, h1 long, h2 long, n long, low long, need int, fresh boolean, run binary"
    )


def _fresh(h1: np.ndarray, h2: np.ndarray, done: set[tuple[int, int]], wanted: np.ndarray) -> np.ndarray:
    """Rows among ``wanted`` whose set this task has not met yet. What it remembers is bounded."""
    out = []
    for i, name in zip(wanted.tolist(), zip(h1[wanted].tolist(), h2[wanted].tolist(), strict=True), strict=True):
        if name not in done:
            done.add(name)
            out.append(i)
    if len(done) > 500_000:
        done.clear()
    return np.array(out, dtype=np.int64)


def _elements(rows: DataFrame, chosen: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """key, set (h1), need of the counted elements of the rows in one bitmap; only of those in another, if there is one."""
    masks = rows.sparkSession.sparkContext.broadcast((chosen, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_rows, of_keys = masks.value
        for given in batches:
            batch = given.filter(pa.array(in_bitmap(of_rows, given.column(3).to_numpy())))
            at = offsets_of(batch.column(2)) // 8
            flat = batch.column(2).buffers()[2]
            keys = np.frombuffer(flat, dtype=np.int64)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            if of_keys is not None:
                some = in_bitmap(of_keys, keys)
                keys, row = keys[some], row[some]
            for a in range(0, len(keys), 50_000):
                own = pa.array(row[a : a + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a : a + 50_000]), batch.column(0).take(own), batch.column(1).take(own)],
                    ["key", "set", "need"],
                )

    given = rows.where("fresh").select("h1", "need", "run", "row")
    return given.mapInArrow(trimmed(run), "key long, set long, need int")


def _groups(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, root: groups of sets (by h1) that share prefix elements, wherever a group has two.

    Sets whose 64-bit names clash only make a group larger: links are told apart by classes.
    """
    # Of equal sets one row is enough. A bitmap names it; where that says little, copies are counted as well.
    chosen = bitmap_of(classes.select(F.col("row").alias("item")), BITMAP_BITS)
    # Keys of one row are of no use to anyone; the number of rows orders the rest.
    counts = _elements(rows, chosen).groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    shared = stored(counts.where("often > 1"), "shingle-shared")
    found = _elements(rows, chosen, bitmap_of(shared.select(F.col("key").alias("item")), BITMAP_BITS))
    # Unsigned order: whether the key is among the counted.
    counted = F.when(F.col("key") >= 0, F.col("key") < COUNTED).otherwise(F.lit(False))
    found = found.join(shared, "key").distinct().withColumn("counted", counted)
    of_set = Window.partitionBy("set")
    place = F.row_number().over(of_set.orderBy(F.col("counted").desc(), "often", "key"))
    q = F.sum(F.col("counted").cast("int")).over(of_set)
    in_prefix = ~F.col("counted") | (F.col("place") <= F.col("need") + F.col("q"))
    keys = stored(
        found.withColumn("place", place).withColumn("q", q).where(in_prefix).select("key", "set"), "shingle-keys"
    )
    middle = keys.groupBy("key").agg(F.min("set").alias("least"), F.max("set").alias("most")).where(
        "least <> most"
    ).select("key", "least")
    return components(keys.join(middle, "key").where("set <> least").select("set", "least"), "shingle-groups")


def _member_sets(given: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """h1, h2, items (packed) of the sets of the texts in a bitmap of names, once per task that meets one."""
    mask = given.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            # Tested where the words are cut, as a worker of its own for the test would stay beside this one.
            some = np.flatnonzero(in_bitmap(mask.value, batch.column(1).to_numpy()))
            for a in range(0, len(some), 256):
                for words in words_of(batch.column(0).take(pa.array(some[a : a + 256])), NOT_SPACE):
                    sets = sets_of(words, k)
                    h1, h2 = sets.names()
                    fresh = _fresh(h1, h2, done, np.flatnonzero(sets.sizes))
                    if len(fresh):
                        packed = sets.packed(fresh, sets.sizes[fresh])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h1[fresh]), pa.array(h2[fresh]), packed], ["h1", "h2", "items"]
                        )

    named = given.select("text", F.xxhash64("text").alias("name"))
    return named.mapInArrow(trimmed(run), "h1 long, h2 long, items binary").groupBy("h1", "h2").agg(
        F.first("items").alias("items")
    )


def _sets_in(column: pa.Array) -> Sets:
    """Sets from their packed elements."""
    at = offsets_of(column) // 8
    raw = column.buffers()[2]
    items = np.frombuffer(raw, dtype=np.uint64)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(
        0, np.uint64
    )
    return Sets(items, at - at[0])


def _upper_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """task, root, low, high, bitmap of each block: the OR of its sets' bitmaps and their sizes."""
    for (task, root), table in runs(batches, 2):
        sets = _sets_in(column_of(table, "items"))
        bits = np.zeros(NODE_BITS // 8, dtype=np.uint8)
        at = sets.items & np.uint64(NODE_BITS - 1)
        np.bitwise_or.at(
            bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        )
        low, high = int(sets.sizes.min()), int(sets.sizes.max())
        yield pa.RecordBatch.from_pylist(
            [{"task": task, "root": root, "low": low, "high": high, "bitmap": bits.tobytes()}], schema=_UPPER
        )


_UPPER = pa.schema(
    [("task", pa.int64()), ("root", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bitmap", pa.binary())]
)


def _passing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sets that go on to another block: rows sorted by task hold a block's sets, then the upper nodes of others that
    they are held against."""
    own: pa.Table | None = None
    block = None
    for (task, root, node_too), table in runs(batches, 3):
        if not node_too:
            own, block = table, task
            sets = _sets_in(column_of(own, "items"))
            places = sets.items & np.uint64(NODE_BITS - 1)
            byte, bit = (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(
                np.uint8
            )
            n = sets.sizes
            continue
        if task != block:
            continue
        for other, low, high, bitmap in zip(
            *(column_of(table, c).to_pylist() for c in ("other", "low", "high", "items")), strict=True
        ):
            inside = (np.frombuffer(bitmap, dtype=np.uint8)[byte] & bit) != 0
            most = np.add.reduceat(inside.astype(np.int64), sets.first[:-1])
            # The smallest set of the block that could link, and the overlap that it asks for.
            least = np.maximum(low, -(-n * percent // 100))
            on = np.flatnonzero(
                (100 * n >= percent * low)
                & (percent * n <= 100 * high)
                & ((100 + percent) * most >= percent * (n + least))
            )
            if len(on):
                chosen = own.take(pa.array(on)).combine_chunks()
                yield from pa.table(
                    {
                        "task": pa.array(np.full(len(on), other)),
                        "root": pa.array(np.full(len(on), root)),
                        "arrived": pa.array(np.ones(len(on), dtype=bool)),
                    } | {c: chosen.column(c) for c in ("node", "weight", "items")}
                ).to_batches()


def _joined(batches: Iterator[pa.RecordBatch], percent: int, count: bool) -> Iterator[pa.RecordBatch]:
    """Links within each block and with sets that have come to it, from rows sorted by (task, root, arrived): u, its
    star's middle v, links."""
    own: pa.Table | None = None
    block = None

    def links_of(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        both = left if right is None else pa.concat_tables([left, right])
        if len(both) < 2:
            return
        rows = np.arange(len(both))
        weight = column_of(both, "weight").to_numpy()
        label, links = tree_join(
            _sets_in(column_of(both, "items")),
            rows[: len(left)],
            None if right is None else rows[len(left) :],
            percent,
            weight if count else None,
        )
        other = np.flatnonzero((label != rows) | (links > 0))
        if len(other):
            names = column_of(both, "node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[other]), pa.array(names[label[other]]), pa.array(links[other])], ["u", "v", "links"]
            )

    for (task, root, arrived), table in runs(batches, 3, 16 * BLOCK_ELEMENTS):
        here = table.select(["node", "weight", "items"])
        if arrived:
            if block == (task, root):
                yield from links_of(here, own)
            continue
        if block == (task, root):
            # A block over the bound comes in parts: each meets those before it.
            yield from links_of(here, own)
            yield from links_of(here, None)
            own = pa.concat_tables([own, here])
        else:
            own, block = here, (task, root)
            yield from links_of(own, None)


def jaccard_links(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    count: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): doc_id, h1, h2, n of every row; node, h1, h2, weight, least (id) of every class; and u,
    v, links of linked classes: v is the middle of u's star in a task.

    ``count``: links hold how many rows of other sets u's sets link with in a task (every pair meets in
    one task). Counting compares all pairs that the trees leave, where components alone need a few.
    """
    spark = docs.sparkSession
    given = _texts(docs, id_col, text_col)
    named = _rows(given, k, percent).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    rows = stored(named, "shingle-rows")
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("n").alias("n"),
        F.min("low").alias("low"),
        F.count(F.lit(1)).alias("weight"),
        F.min("doc_id").alias("least"),
        F.min("text_name").alias("text_name"),
        F.min(F.when(F.col("fresh"), F.col("row"))).alias("row"),
    )
    # Named in the written table, so every reader sees the same names, and no two classes share one.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    groups = _groups(rows, classes)
    roots_too = groups.select(F.col("node").alias("h1"), "root").unionByName(
        groups.select(F.col("root").alias("h1"), "root").distinct()
    )
    members = stored(
        classes.join(roots_too, "h1").select("node", "h1", "h2", "n", "low", "weight", "text_name", "root"),
        "shingle-members",
    )
    sets = _member_sets(given, k, bitmap_of(members.select(F.col("text_name").alias("item")), BITMAP_BITS))

    of_group = members.groupBy("root").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("rows"))
    small = (F.col("elements") <= BLOCK_ELEMENTS) & (F.col("rows") <= BLOCK_ROWS)
    total = of_group.agg(F.sum("elements")).first()[0] or 0
    bins = int(total // BLOCK_ELEMENTS) + spark.sparkContext.defaultParallelism
    light = ["h1", "h2", "task", "root", "large", "node", "weight"]
    placed = members.join(of_group.where(small).select("root"), "root").withColumn(
        "task", F.pmod(F.xxhash64("root"), F.lit(bins))
    )
    assigned = placed.withColumn("large", F.lit(False)).select(*light)
    large = of_group.where(~small).select("root")
    any_large = not large.isEmpty()
    if any_large:
        assigned = assigned.unionByName(
            _blocks(members.join(large, "root")).withColumn("large", F.lit(True)).select(*light)
        )
    # Sets are read and joined once, for groups of either kind.
    held_sets = assigned.join(sets, ["h1", "h2"]).select("task", "root", "large", "node", "weight", "items")
    here = ["task", "root", "arrived", "node", "weight", "items"]
    if any_large:
        held_sets = stored(held_sets, "shingle-blocks")
    work = held_sets.withColumn("arrived", F.lit(False)).select(*here)
    if any_large:
        blocks = held_sets.where("large").drop("large")
        upper = (
            blocks.repartition("task")
            .sortWithinPartitions("task", "root")
            .select("task", "root", "node", "weight", "items")
            .mapInArrow(_upper_nodes, "task long, root long, low long, high long, bitmap binary")
        )
        upper = stored(upper, "shingle-upper")
        x, y = upper.drop("bitmap").alias("x"), upper.alias("y")
        fits = (F.col("x.root") == F.col("y.root")) & (F.col("x.task") < F.col("y.task")) & (
            100 * F.col("x.high") >= percent * F.col("y.low")
        ) & (100 * F.col("y.high") >= percent * F.col("x.low"))
        none = F.lit(None).cast("long")
        against = x.join(y, fits).select(
            "x.task",
            "x.root",
            F.lit(True).alias("node_too"),
            none.alias("node"),
            none.alias("weight"),
            F.col("y.bitmap").alias("items"),
            F.col("y.task").alias("other"),
            "y.low",
            "y.high",
        )
        held = blocks.select(
            "task",
            "root",
            F.lit(False).alias("node_too"),
            "node",
            "weight",
            "items",
            none.alias("other"),
            none.alias("low"),
            none.alias("high"),
        )
        tested = held.unionByName(against).repartition("task").sortWithinPartitions("task", "root", "node_too")
        arrived = tested.mapInArrow(
            lambda b: _passing(b, percent),
            "task long, root long, arrived boolean, node long, weight long, items binary",
        )
        work = work.unionByName(arrived)
    found = work.repartition("task").sortWithinPartitions("task", "root", "arrived").mapInArrow(
        trimmed(lambda b: _joined(b, percent, count)), "u long, v long, links long"
    )
    return rows, classes, stored(found, "shingle-links")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` with ``task``: blocks of a group by size level (sizes within a quarter) and smallest element, cut
    again where such a cell is too large."""
    leveled = members.withColumn("level", F.floor(F.log(1.25, F.col("n"))).cast("int"))

    def cut(rows: DataFrame, by: list[str], name: str, of: Column) -> DataFrame:
        sizes = rows.groupBy(*by).agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("rows"))
        many = sizes.select(
            *by,
            F.ceil(
                F.greatest(F.col("elements") / BLOCK_ELEMENTS, F.col("rows") / BLOCK_ROWS)
            ).cast("int").alias("many"),
        )
        return rows.join(many, by).withColumn(name, F.pmod(of, F.col("many")).cast("int")).drop("many")

    slotted = cut(leveled, ["root", "level"], "slot", F.xxhash64("low"))
    salted = cut(slotted, ["root", "level", "slot"], "salt", F.xxhash64("node", F.lit(5)))
    return salted.withColumn("task", F.xxhash64("root", "level", "slot", "salt"))


def linked_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    count: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; with ``count`` also n_links, the other rows that it links with."""
    rows, classes, links = jaccard_links(docs, id_col=id_col, text_col=text_col, k=k, percent=percent, count=count)
    found = components(links.select("u", "v"), "shingle-components")
    full = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(full.groupBy("root").agg(F.min("least").alias("component_id")), "shingle-least")
    of_class = full.join(least, "root").select("node", "h1", "h2", "component_id", "weight")
    if count:
        to_others = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
        of_class = of_class.join(to_others, "node", "left").withColumn(
            "n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0))
        )
    names = ["component_id", "n_links"] if count else ["component_id"]
    # Written, so that the join below has a shuffle on either side and a large class's rows can be split.
    of_class = stored(of_class.select("h1", "h2", *names), "shingle-counts")
    out = rows.where("n > 0").join(of_class, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), *names)
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty.withColumn("n_links", F.lit(0).cast("long")) if count else empty)
