"""Token ids in binary shards, compressed by Re-Pair grammars with random-access decoding.

Texts in ascending id order are encoded whole, an end id is appended to each, and runs of
documents of ``shard_tokens`` ids become shard files: a shard is closed with the document that
fills it. A shard's id sequence is compressed by Re-Pair: in rounds, the most frequent adjacent
pairs are replaced by new nonterminals, as many at once as can be without touching each other (no
symbol is the right side of one and the left side of another, so all counts of a round hold).

Rounds go on until no rule would pay for itself: one takes its two sides and four bytes for its
length, and saves a symbol per occurrence, so a pair must occur ``worth`` times; or until the
nonterminals of 16 bits are used up. Beyond these, symbols grow: of the first 2.1 million ids of
sf0.1, all 46,363 pairs that occur 8 times leave 883,158 symbols, which take 2.26 MB with 17 bits a
symbol and a side; 16 bits and 15,279 rules take 2.28 MB, and are read without shifting bits. A
vocabulary that leaves fewer than 256 nonterminals has symbols of 32 bits. The end id takes part
in no pair, so documents begin and end between symbols.

File (little endian): magic ``RPTK``, then a header of eight unsigned 64-bit numbers
(version, first nonterminal, rules, symbols, documents, ids, bytes of a symbol, sampling
step), the rules (left and right, of a symbol's width), the rules' expansion lengths (u32), the
symbol sequence (u16 or u32), the ids before every ``step``-th symbol (u64), the first symbol of
every document and one more (u64), document ids (i64) and flags of null ids (u8).

Each task writes files under names that no other attempt uses and reports them in a
manifest; only committed rows are ever read. ``start`` of a shard is the sum of ids before
it: summed within a task's partition, then along the partitions in two levels.

Byte-level BPE with its usual splitting rule ends a token before a blank and at other places
that depend on their neighbours alone, so most texts are encoded piece by piece and equal
pieces once; any other text or tokenizer is encoded in one piece. Both give the library's
own ids. What a process remembers of pieces is bounded in number and in bytes.

A null text is empty and has the end id alone. Null document ids come first. Repeated rows
follow each other. Columns other than the two named ones are not read, whatever their names. An
empty table gives no shard. One text is encoded by one task, in some 60 bytes of arrays per byte
of the text (or of ``ENCODED_BYTES`` of shorter texts), and lies in one shard however long it is.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.shared import filesystem, offsets_of, running_sum, scratch, slices, stored
from millstone.llm.words import mixed, powers

MAGIC, VERSION, STEP = b"RPTK", 2, 256
END = 0
SHARD_TOKENS = 1 << 21
#: Rows of a sorted partition, in expectation; a task cuts it into shards by ids.
PART_ROWS = 4000
#: Bytes of text encoded at once.
ENCODED_BYTES = 2 << 20
#: A round makes half of the rules that are left, within these bounds.
ROUND_RULES = 1000, 8192
#: Pieces, bytes of pieces and ids that a process remembers; beyond, it starts afresh.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_IDS = 1_500_000, 32 << 20, 8 << 20
# Bytes of ASCII white space; of punctuation that begins no contraction; of letters and digits.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[np.frombuffer(b".,!;:?%&$#*", dtype=np.uint8)] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes of the letters A to Z, a to z and U+00C0 to U+023F; the line feed as byte-level vocabularies spell it.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
FEED = "\u010a"
#: First bytes of white space beyond ASCII, and what follows them (second byte, lowest and highest third byte).
_WIDE = {
    0xC2: [(0x85, None, None), (0xA0, None, None)],
    0xE1: [(0x9A, 0x80, 0x80)],
    0xE2: [(0x80, 0x80, 0x8A), (0x80, 0xA8, 0xA9), (0x80, 0xAF, 0xAF), (0x81, 0x9F, 0x9F)],
    0xE3: [(0x80, 0x80, 0x80)],
}


def cut(texts: pa.Array, apart: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Pieces that are encoded alone, one after another, and how many each text has.

    Cuts lie before a blank, around a line feed, and between an ASCII letter or digit and
    punctuation: at each of them the splitting rule ends a token, whatever comes before or after.
    A text in which a blank or line feed meets other white space is one piece, as is every text if
    ``apart`` is false; an empty text has none.
    """
    at = offsets_of(texts)
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    n = len(data)
    begins = np.zeros(n, dtype=bool)
    whole = np.ones(len(texts), dtype=bool)
    if apart and n:
        blank, feed, white = data == 32, data == 10, _WHITE[data]
        begins |= blank | feed
        begins[1:] |= feed[:-1] | (_PUNCTUATION[data[1:]] & _ALNUM[data[:-1]])
        either = blank | feed
        odd = [np.flatnonzero((either[1:] & white[:-1]) | (white[1:] & either[:-1]))]
        odd = [x[~np.isin(x + 1, at)] for x in odd]
        for first, rest in _WIDE.items():
            p = np.flatnonzero(data == first)
            for second, low, high in rest:
                q = p[(p + (1 if low is None else 2)) < n]
                q = q[data[q + 1] == second]
                odd.append(q if low is None else q[(data[q + 2] >= low) & (data[q + 2] <= high)])
        whole[:] = False
        whole[np.searchsorted(at, np.concatenate(odd), side="right") - 1] = True
        for i in np.flatnonzero(whole).tolist():
            begins[at[i] : at[i + 1]] = False
    begins[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at))
    offsets = np.append(starts, n).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), counts


def _of_letters(data: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Which pieces are letters of ``_LETTERS`` after an optional blank: one token to the splitting rule."""
    bad = ~_LETTERS[data]
    # Two signs among the letters of U+00C0 to U+00FF: U+00D7 and U+00F7.
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    upto = np.concatenate(([0], np.cumsum(bad)))
    begin, stop = at[which], at[which + 1]
    begin = begin + ((data[begin] == 32) & (stop - begin > 1))
    return upto[stop] == upto[begin]


class Pieces:
    """Numbers of known pieces: a hash table in arrays. A hit counts only if the bytes are equal."""

    SLOTS = 1 << 22

    def __init__(self) -> None:
        self.table = np.full(self.SLOTS, -1, dtype=np.int32)
        self.keys, self.begin, self.sizes = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int64), np.zeros(
            1 << 18, np.int64
        )
        self.bytes, self.used = np.zeros(1 << 21, np.uint8), 0

    def find(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's number, or -1; the pieces' hashes, bytes and offsets."""
        at = offsets_of(pieces)
        data = np.frombuffer(pieces.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        sizes = np.diff(at)
        inner = np.arange(len(data)) - np.repeat(at[:-1], sizes)
        keys = mixed(
            np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[inner], at[:-1])
            + sizes.astype(np.uint64)
        )
        out = np.full(len(pieces), -1, dtype=np.int64)
        todo, slot = np.arange(len(pieces)), (keys >> np.uint64(42)).astype(np.int64)
        while len(todo):
            got = self.table[slot[todo]]
            todo, got = todo[got >= 0], got[got >= 0]
            same = self.keys[got] == keys[todo]
            out[todo[same]] = got[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) % self.SLOTS
        hit = np.flatnonzero(out >= 0)
        if len(hit):
            equal = self.sizes[out[hit]] == sizes[hit]
            out[hit[~equal]] = -1
            hit = hit[equal]
            n = sizes[hit]
            stop = np.cumsum(n)
            own = np.arange(int(stop[-1]) if len(stop) else 0)
            differ = self.bytes[own + np.repeat(self.begin[out[hit]] - (stop - n), n)] != data[
                own + np.repeat(at[hit] - (stop - n), n)
            ]
            if differ.any():
                out[hit[np.unique(np.searchsorted(stop, np.flatnonzero(differ), side="right"))]] = -1
        return out, keys, data, at

    def add(self, which: np.ndarray, numbers: np.ndarray, keys: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        """Remember some of the pieces of ``find`` by new numbers. One whose hash is taken by another piece is not found
        later."""
        sizes = np.diff(at)[which]
        stop = np.cumsum(sizes)
        total = int(stop[-1])
        while self.used + total > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while int(numbers[-1]) >= len(self.keys):
            self.keys, self.begin, self.sizes = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.begin, self.sizes)
            )
        self.bytes[self.used : self.used + total] = data[
            np.arange(total) + np.repeat(at[which] - (stop - sizes), sizes)
        ]
        self.keys[numbers], self.begin[numbers], self.sizes[numbers] = keys[which], self.used + stop - sizes, sizes
        self.used += total
        todo, slot = np.arange(len(which)), (keys[which] >> np.uint64(42)).astype(np.int64)
        while len(todo):
            free = todo[self.table[slot[todo]] < 0]
            self.table[slot[free]] = numbers[free]
            todo = todo[self.table[slot[todo]] != numbers[todo]]
            slot[todo] = (slot[todo] + 1) % self.SLOTS


class Encoder:
    """Whole texts to ids with the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        said = json.loads(self.tokenizer.to_str())
        before = said.get("pre_tokenizer") or {}
        added = "".join(x["content"] for x in said.get("added_tokens") or ())
        self.by_piece = not set(added) & set(" \n.,!;:?%&$#*") and said.get(
            "normalizer"
        ) is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        # A token that no piece's encoding can hold parts the pieces of one call.
        self.between = next(
            (
                x["content"]
                for x in said.get("added_tokens") or ()
                if x.get("special") and not (x.get("lstrip") or x.get("rstrip") or x.get("single_word"))
            ),
            None,
        )
        self.between_id = self.tokenizer.token_to_id(self.between) if self.between else None
        # Words of letters are one token to the splitting rule, so they need none: they are parted by line feeds alone.
        self.words, self.feed = None, None
        if self.by_piece and self.tokenizer.model.token_to_id(FEED) is not None:
            self.words, self.feed = Tokenizer(self.tokenizer.model), self.tokenizer.model.token_to_id(FEED)
            self.words.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.Split("\n", "isolated"),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )
        if hasattr(self.tokenizer.model, "_resize_cache"):
            # Pieces are remembered here; the model need not remember them too.
            self.tokenizer.model._resize_cache(0)
        self._forget()

    def _forget(self) -> None:
        # Piece 0 is the end id.
        self.known = Pieces()
        self.flat, self.begin = np.zeros(1 << 20, dtype=np.int32), np.zeros(1 << 18, dtype=np.int64)
        self.flat[0], self.begin[1], self.count = END, 1, 1

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        if self.by_piece and self.between and not any(self.between in p for p in pieces):
            raw = np.array(
                self.tokenizer.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)[0].ids,
                dtype=np.int32,
            )
            cuts = np.flatnonzero(raw == self.between_id)
            if len(cuts) == len(pieces) - 1:
                return np.delete(raw, cuts), np.diff(np.concatenate(([-1], cuts, [len(raw)]))) - 1
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())), sizes

    def _ids_of_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """``_ids_of`` for pieces of letters, none of which holds a line feed; None where the tokenizer treats these
        otherwise."""
        raw = np.array(
            self.words.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.int32
        )
        cuts = np.flatnonzero(raw == self.feed)
        if len(cuts) != len(pieces) - 1:
            return None
        return np.delete(raw, cuts), np.diff(np.concatenate(([-1], cuts, [len(raw)]))) - 1

    def _numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Numbers of distinct pieces; new ones are encoded and remembered."""
        if not len(pieces):
            return np.zeros(0, dtype=np.int64)
        out, keys, data, at = self.known.find(pieces)
        new = np.flatnonzero(out < 0)
        if len(new):
            lettered = _of_letters(data, at, new) if self.words else np.zeros(len(new), dtype=bool)
            found = self._ids_of_words(pieces.take(pa.array(new[lettered])).to_pylist()) if lettered.any() else None
            if found is None:
                lettered[:] = False
            new = np.concatenate([new[lettered], new[~lettered]])
            parts = [] if found is None else [found]
            if not lettered.all():
                parts.append(self._ids_of(pieces.take(pa.array(new[int(lettered.sum()) :])).to_pylist()))
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            n, end = self.count, int(self.begin[self.count])
            while n + len(new) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            while end + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.begin[n + 1 : n + len(new) + 1] = end + np.cumsum(sizes)
            self.flat[end : end + len(ids)] = ids
            self.count += len(new)
            out[new] = np.arange(n, n + len(new))
            self.known.add(new, out[new], keys, data, at)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and the number of each text's ids."""
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if self.count > REMEMBERED or self.known.used > REMEMBERED_BYTES or int(
            self.begin[self.count]
        ) > REMEMBERED_IDS:
            self._forget()
        found, counts = cut(texts.fill_null(""), self.by_piece)
        coded = found.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.cumsum(counts) + np.arange(len(texts))
        pieces = np.zeros(len(number) + len(texts), dtype=np.int64)
        inner = np.ones(len(pieces), dtype=bool)
        inner[ends] = False
        pieces[inner] = number
        begin = self.begin[pieces]
        sizes = self.begin[pieces + 1] - begin
        stop = np.cumsum(sizes)
        places = np.repeat(begin - (stop - sizes), sizes)
        places += np.arange(len(places))
        ids = self.flat[places]
        return ids, np.diff(np.concatenate(([0], stop[ends])))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder; what it remembers serves later tasks as well."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- Re-Pair ---------------------------------------------------------------------------


CELLS = 1 << 20


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash cell of each pair of symbols."""
    return (
        (a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(12)
    ).astype(np.int64)


def _frequent(seq: np.ndarray, cell: np.ndarray, least: int, most: int) -> np.ndarray:
    """Pairs (as keys) that occur ``least`` times or more, the most frequent ones first; about ``4 * most`` at least, if
    there are."""
    full = np.bincount(cell, minlength=CELLS)
    # A pair occurs no more often than its hash cell; only pairs of the fullest cells are sorted and counted.
    counts = np.sort(full[full >= least])[::-1]
    full_enough = max(least, int(counts[min(4 * most, len(counts)) - 1])) if len(counts) else least
    found = _counted(seq, full, cell, full_enough)
    # Cells may be that full of rarer pairs alone.
    return found if len(found) or full_enough == least else _counted(seq, full, cell, least)


def _counted(seq: np.ndarray, full: np.ndarray, cell: np.ndarray, least: int) -> np.ndarray:
    """Pairs of the cells that hold ``least`` that occur so often themselves, the most frequent ones first."""
    at = np.flatnonzero((full >= least).take(cell))
    a, b = seq.take(at), seq.take(at + 1)
    keys = ((a.astype(np.int64) << 32) | b)[(a != END) & (b != END)]
    if not len(keys):
        return keys
    keys.sort()
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(begin, len(keys)))
    enough = n >= least
    return keys[begin][enough][np.argsort(-n[enough], kind="stable")]


def _apart(keys: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first pairs of which none touches another, each in a cell of its own."""
    left, right = keys >> 32, keys & 0xFFFFFFFF
    lefts: set[int] = set()
    rights: set[int] = set()
    cells: set[int] = set()
    out = []
    for a, b, cell in zip(left.tolist(), right.tolist(), _cells(left, right).tolist(), strict=True):
        if a in rights or b in lefts or cell in cells or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        cells.add(cell)
        out.append((a, b))
        if len(out) == most:
            break
    return out


def _replaced(seq: np.ndarray, cell: np.ndarray, pairs: list[tuple[int, int]], first: int) -> np.ndarray:
    """The sequence with every occurrence of ``pairs[i]`` (from the left) replaced by ``first + i``."""
    left, right = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True))
    rule_of = np.full(CELLS, -1, dtype=np.int32)
    rule_of[_cells(left, right)] = np.arange(len(pairs))
    rule = rule_of.take(cell)
    at = np.flatnonzero(rule >= 0)
    rule = rule.take(at)
    same = (seq.take(at) == left.take(rule)) & (seq.take(at + 1) == right.take(rule))
    at, rule = at[same], rule[same]
    # Only a pair of equal symbols can overlap itself: every other place of a run is taken.
    if len(at) and (left == right).any():
        run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
        taken = (at - at[np.searchsorted(run, run)]) % 2 == 0
        at, rule = at[taken], rule[taken]
    keep = np.ones(len(seq), dtype=bool)
    keep[at + 1] = False
    out = seq[keep]
    out[at - np.arange(len(at))] = first + rule
    return out


def worth(width: int) -> int:
    """How often a pair must occur to save more bytes than its rule takes, with symbols of ``width`` bytes."""
    return (2 * width + 4) // width + 1


def repair(ids: np.ndarray, first: int, *, rules: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): the ids with frequent pairs replaced; rule i makes ``first + i`` of its two sides.

    Rounds stop when no pair occurs ``least`` times or ``rules`` are used up.
    """
    seq = ids.astype(np.int32)
    made: list[tuple[int, int]] = []
    while len(made) < rules and len(seq) > 1:
        left = rules - len(made)
        most = min(left, max(ROUND_RULES[0], min(ROUND_RULES[1], -(-left // 2))))
        cell = _cells(seq[:-1], seq[1:])
        pairs = _apart(_frequent(seq, cell, least, most), most)
        if not pairs:
            break
        seq = _replaced(seq, cell, pairs, first + len(made))
        made += pairs
    return seq, np.array(made, dtype=np.uint32).reshape(-1, 2)


# --- shard files -----------------------------------------------------------------------


def packed_shard(ids: np.ndarray, sizes: np.ndarray, doc_ids: list[int | None], vocabulary: int) -> bytes:
    """A shard file's bytes."""
    room = 65536 - vocabulary
    width = 2 if room > 256 else 4
    symbols, rules = repair(
        ids,
        vocabulary,
        rules=(1 << 8 * width) - vocabulary if width == 2 else (1 << 31) - vocabulary,
        least=worth(width),
    )
    length = np.ones(vocabulary + len(rules), dtype=np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        length[vocabulary + i] = length[a] + length[b]
    before = np.concatenate(([0], np.cumsum(length[symbols])))
    firsts = np.searchsorted(before, np.concatenate(([0], np.cumsum(sizes))))
    head = struct.pack("<4s8Q", MAGIC, VERSION, vocabulary, len(rules), len(symbols), len(sizes), len(ids), width, STEP)
    return b"".join(
        [
            head,
            rules.astype(f"<u{width}").tobytes(),
            length[vocabulary:].astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
            before[:-1:STEP].astype("<u8").tobytes(),
            firsts.astype("<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        ]
    )


@dataclass
class Shard:
    """A shard file's contents; ids are decoded on demand."""

    vocabulary: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    sampled: np.ndarray
    firsts: np.ndarray
    doc_ids: list[int | None]
    n_tokens: int
    step: int

    @classmethod
    def parse(cls, raw: bytes) -> Shard:
        magic, version, vocabulary, rules, symbols, docs, tokens, width, step = struct.unpack_from("<4s8Q", raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = struct.calcsize("<4s8Q")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        made, lengths = take(f"<u{width}", 2 * rules).reshape(-1, 2), take("<u4", rules)
        seq, sampled, firsts = take(f"<u{width}", symbols), take("<u8", -(-symbols // step)), take("<u8", docs + 1)
        ids, none = take("<i8", docs), take("u1", docs)
        if at != len(raw):
            raise ValueError("a token shard of the wrong length")
        return cls(
            vocabulary,
            made,
            lengths,
            seq,
            sampled,
            firsts,
            [None if z else i for i, z in zip(ids.tolist(), none.tolist(), strict=True)],
            tokens,
            step,
        )

    def __post_init__(self) -> None:
        """Expansions of all symbols that occur in rules, each right after the other."""
        self.size = np.concatenate([np.ones(self.vocabulary, dtype=np.int64), self.lengths.astype(np.int64)])
        ends = np.cumsum(self.size)
        self.begin = ends - self.size
        self.flat = np.empty(int(ends[-1]), dtype=np.int32)
        self.flat[: self.vocabulary] = np.arange(self.vocabulary)
        sides = self.rules.astype(np.int64)
        newest = np.maximum.accumulate(sides.max(axis=1)) if len(sides) else np.zeros(0, dtype=np.int64)
        done = 0
        while done < len(sides):
            # The next rules whose sides are all there.
            stop = int(np.searchsorted(newest, self.vocabulary + done))
            parts = sides[done:stop].ravel()
            self.flat[self.begin[self.vocabulary + done] : ends[self.vocabulary + stop - 1]] = self._gathered(parts)
            done = stop

    def _gathered(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        stop = np.cumsum(n)
        return self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begin[symbols] - (stop - n), n)]

    def expanded(self, a: int, b: int) -> np.ndarray:
        """Ids of symbols a to b."""
        return self._gathered(self.symbols[a:b])

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its end id included."""
        return self.expanded(int(self.firsts[i]), int(self.firsts[i + 1]))

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard, from the sampled counts; nothing before them is expanded but part of a step."""
        b = min(b, self.n_tokens)
        if a >= b:
            return np.zeros(0, dtype=np.int32)
        k = int(np.searchsorted(self.sampled, a, side="right")) - 1
        s, at = k * self.step, int(self.sampled[k])
        sizes = np.cumsum(self.size[self.symbols[s : s + self.step + (b - a)]]) + at
        e = s + int(np.searchsorted(sizes, b, side="left")) + 1
        return self.expanded(s, e)[a - at : b - at]


# --- distributed -----------------------------------------------------------------------

MANIFEST = "part int, seq int, file string, docs long, tokens long, bytes long"


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Encode and write all rows; returns the stored manifest with ``start``, the ids of all shards before each."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(spark.sparkContext.defaultParallelism, given.count() // part_rows + 1)
    dealt = given.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        fs, base = filesystem(folder)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, sizes, names, size, seq
            n = np.concatenate(sizes)
            raw = packed_shard(np.concatenate(held), n, names, encoder.vocabulary)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.rptk"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(raw)
            row = {
                "part": part, "seq": seq, "file": f"{folder}/{name}", "docs": len(n), "tokens": size, "bytes": len(raw)
            }
            held, sizes, names, size, seq = [], [], [], 0, seq + 1
            kinds = [
                ("part", pa.int32()),
                ("seq", pa.int32()),
                ("file", pa.string()),
                ("docs", pa.int64()),
                ("tokens", pa.int64()),
                ("bytes", pa.int64()),
            ]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

        for batch in batches:
            for a, b in slices(batch.column(1).fill_null(""), ENCODED_BYTES):
                some = batch.slice(a, b - a)
                ids, n = encoder.encode(some.column(1))
                ends, doc_ids = np.cumsum(n), some.column(0).to_pylist()
                done, taken = 0, 0
                while done < len(n):
                    # Up to the document that fills the shard, if it is among these.
                    stop = min(int(np.searchsorted(ends, taken + shard_tokens - size)) + 1, len(n))
                    upto = int(ends[stop - 1])
                    held.append(ids[taken:upto].copy())
                    sizes.append(n[done:stop])
                    names += doc_ids[done:stop]
                    size += upto - taken
                    done, taken = stop, upto
                    if size >= shard_tokens:
                        yield shard()
        if names:
            yield shard()

    manifest = stored(dealt.mapInArrow(run, MANIFEST), "token-manifest")
    bases = running_sum(manifest.groupBy("part").agg(F.sum("tokens").alias("of_part")), [], "part", "of_part").select(
        "part", F.col("before").alias("base")
    )
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(bases, "part").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    ).drop("base")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    shard = Shard.parse(f.read())
                at = np.concatenate(([0], np.cumsum(shard.size[shard.symbols])))[shard.firsts.astype(np.int64)]
                ids = shard.expanded(0, len(shard.symbols)).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                starts, sizes = start + at[:-1], np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    schema=kinds,
                )

    # A row is a shard, so the rows are spread by number: each task decodes a few, however small the table is.
    shards = manifest.count()
    tasks = min(shards, 4 * manifest.sparkSession.sparkContext.defaultParallelism + shards // 64)
    return manifest.select("file", "start").repartition(max(tasks, 1), "file").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
