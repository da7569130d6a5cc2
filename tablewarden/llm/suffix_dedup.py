"""Removal of long repeated byte strings with a distributed, sparse suffix array.

A byte goes if some ``length``-byte string that covers it also starts anywhere else in the table. Three steps find
those strings exactly, without giving every suffix of the corpus to the shuffle:

1. Sparse suffixes. Each ``length``-byte window chooses the gram (three quarters of its length) of smallest hash in it as its anchor. Equal
   windows choose equal anchors at equal places, so only windows whose anchor's gram repeats can repeat. About one
   suffix in fifty is an anchor.
2. Suffix order. Sampled splitters (``repartitionByRange``) range-partition the anchors by leading bytes, gram hash and
   hash of the span of all windows that choose it. Each bucket sorts locally by a multikey quicksort that refines tied runs key by
   key, and equal neighbours are marked; the first and last row of each bucket are compared across boundaries.
   The place of a row is part of the range key, so a passage that a third of the corpus holds fills many buckets.
   If a whole span repeats, so does every window in it. If only the gram does, its windows stay open.
3. Open windows, and those of one witness for each repeated span that shares a gram with them, become suffixes of
   their own (leading bytes and a hash of their ``length`` bytes) and go through the same order. These lie
   round the ends of repeated passages.

The same order also runs over words: a word is then one symbol, named by its 64-bit hash, in place of a byte.

Hashes are 64-bit polynomials over random byte values. Rows count as equal if leading bytes and hashes agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tablewarden.llm.common import SPACE, removed, stored, tasks, without

LENGTH = 400
#: Bytes of a document that are hashed at a time; bounds a task's memory for any text length.
STEP = 1 << 18
#: Texts that a task unpacks together.
TEXTS_AT_ONCE = 200
#: Suffixes of one sorted bucket.
BUCKET_ROWS = 400_000

#: Share of a window that its anchor's gram takes. A longer gram means more anchors and fewer open windows.
GRAM_SHARE = 0.75

_WORDS = re.compile(rf"[^{SPACE}]+".encode())
_PLACE = np.uint64((1 << 20) - 1)


def gram_of(length: int) -> int:
    return max(1, int(length * GRAM_SHARE))


class _Rolling:
    """Polynomial hashes of substrings, modulo 2^64, from prefix sums over one block of bytes."""

    def __init__(self, seed: int, size: int):
        draw = np.random.default_rng(seed)
        self.byte = draw.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.mask = self.byte[0]
        base = int(draw.integers(0, 1 << 62)) * 2 + 1
        self.power = self._powers(base, size)
        self.inverse = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    def prefix(self, block: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(block) + 1, np.uint64)
        values = self.byte[block] if block.dtype == np.uint8 else _mixed(block ^ self.mask)
        np.cumsum(values * self.power[: len(block)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[at]) * self.inverse[at])

    def runs(self, sums: np.ndarray, at: int, count: int, size: int) -> np.ndarray:
        """Hashes of ``count`` substrings of one size that start one after the other."""
        return _mixed((sums[at + size : at + size + count] - sums[at : at + count]) * self.inverse[at : at + count])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_HASHES: dict[int, tuple[_Rolling, _Rolling]] = {}


def _hashes(length: int) -> tuple[_Rolling, _Rolling]:
    if length not in _HASHES:
        _HASHES[length] = (_Rolling(11, STEP + 4 * length), _Rolling(12, STEP + 4 * length))
    return _HASHES[length]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    if width == 1:
        return x
    count = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _leading(block: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The first ``min(size, 8)`` bytes as a number that sorts like them; of words, the first one's hash."""
    if block.dtype != np.uint8:
        return block[at]
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | (block[at + i].astype(np.uint64) if i < size else np.uint64(0))
    return out ^ np.uint64(1 << 63)


def anchors(data: np.ndarray, length: int) -> list[np.ndarray]:
    """For each anchor of one text: first and last start of the windows that choose it, leading bytes and hash of its
    gram, hash of the span of those windows (with the anchor's place in it)."""
    n, gram = len(data), gram_of(length)
    starts, reach = n - length + 1, length - gram
    one, two = _hashes(length)
    found: list[list[np.ndarray]] = []
    for base in range(0, max(0, starts), STEP):
        take = min(STEP, starts - base)
        block = data[base : base + take + length]
        sums, other = one.prefix(block), two.prefix(block)
        key = one.runs(sums, 0, take + reach, gram)
        key = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint64)
        chosen = (_sliding_min(key, reach + 1) & _PLACE).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        hi = np.concatenate([lo[1:], [take]]) - 1
        at = chosen[lo]
        shape = ((at - lo) * (2 * length + 1) + (hi - at) + length).astype(np.uint64)
        span = _mixed(two.of(other, lo, hi + length) + shape * np.uint64(0xD1342543DE82EF95))
        found.append([lo + base, hi + base, _leading(block, at, gram), one.of(sums, at, at + gram), span])
    return [np.concatenate(x) for x in zip(*found)] if found else [*[np.empty(0, np.int64)] * 2, *[np.empty(0, np.uint64)] * 3]


def windows(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Place (twice), leading bytes and hash of the windows that start at the sorted places ``at``."""
    one, _ = _hashes(length)
    found: list[list[np.ndarray]] = []
    for base in range(0, len(data), STEP):
        here = at[np.searchsorted(at, base) : np.searchsorted(at, base + STEP)]
        if len(here):
            block = data[base : base + STEP + length]
            own, sums = here - base, one.prefix(block)
            found.append([here, here, _leading(block, own, length), one.of(sums, own, own + length), np.zeros(len(own), np.uint64)])
    return [np.concatenate(x) for x in zip(*found)] if found else [*[np.empty(0, np.int64)] * 2, *[np.empty(0, np.uint64)] * 3]


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted order by all keys, and for each key whether a sorted row differs from the one before in the keys so far.
    Each further key only sorts the rows that the earlier ones leave tied."""
    order = np.argsort(keys[0], kind="quicksort")
    new = np.ones(len(order), bool)
    new[1:] = keys[0][order][1:] != keys[0][order][:-1]
    steps = [new]
    for key in keys[1:]:
        tied = ~new | np.concatenate([~new[1:], [False]])
        rows = np.flatnonzero(tied)
        if len(rows):
            run = np.cumsum(new)[rows]
            order[rows] = order[rows][np.lexsort((key[order[rows]], run))]
        value = key[order]
        new = new.copy()
        new[1:] |= value[1:] != value[:-1]
        steps.append(new)
    return order, steps


def _repeats(new: np.ndarray) -> np.ndarray:
    """Rows that equal the row before or after."""
    alone = new & np.concatenate([new[1:], [True]])
    return ~alone


def _witness(group: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The first row of every repeated span whose gram also occurs in other spans, or may do so in the next bucket."""
    run = np.cumsum(group) - 1
    kinds = np.bincount(run, weights=span)
    mixed = kinds > 1
    mixed[[0, -1]] = True
    return span & _repeats(span) & mixed[run]


_SUFFIX = "th long, size long, lo long, hi long, lead long, k1 long, k2 long"
_MARKED = "th long, size long, lo long, hi long, level int, edge boolean, lead long, k1 long, k2 long"
_TEXT = ["th", "size"]


def _suffix_batch(batch: pa.RecordBatch, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    which = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(5)]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c).take(which) for c in _TEXT], *[pa.array(c.view(np.int64), pa.int64()) for c in columns]],
        [*_TEXT, "lo", "hi", "lead", "k1", "k2"],
    )


def _bytes(column: pa.Array, packed: bool = False) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    for value in column:
        raw = value.as_buffer() if value.is_valid else b""
        if packed and len(raw):
            raw = unpack.decompress(raw)
        yield np.frombuffer(raw, np.uint8) if len(raw) else np.empty(0, np.uint8)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a text."""
    raw = data.tobytes()
    spans = np.array([m.span() for m in _WORDS.finditer(raw)], np.int64).reshape(-1, 2)
    names = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in spans.tolist()), np.uint64, len(spans))
    return names, spans[:, 0], spans[:, 1]


def _symbols(data: np.ndarray, by_words: bool) -> np.ndarray:
    return word_spans(data)[0] if by_words else data


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with its column ``body`` compressed, for the two joins that have to move the texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor()
        for batch in batches:
            at = batch.schema.get_field_index("body")
            yield batch.set_column(at, "body", pa.array([pack.compress(v.as_buffer()) for v in batch.column(at)], pa.binary()))

    return docs.mapInArrow(emit, docs.schema)


def _range() -> Column:
    """A range of starts ``lo..hi`` as one long."""
    return F.shiftleft("lo", 20).bitwiseOR(F.col("hi") - F.col("lo"))


def _unpacked(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = ranges >> 20
    return lo, lo + (ranges & ((1 << 20) - 1))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of an array column row by row; a null row is empty."""
    for value in column:
        yield value.values.to_numpy() if value.is_valid else np.empty(0, np.int64)


def _anchor_rows(docs: DataFrame, length: int, by_words: bool) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield _suffix_batch(batch, [anchors(_symbols(d, by_words), length) for d in _bytes(batch.column("body"))])

    return docs.mapInArrow(emit, _SUFFIX)


def _window_rows(docs: DataFrame, length: int, by_words: bool) -> DataFrame:
    """Suffixes of the windows ``marks`` of ``docs (th, size, body, marks)``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            parts = []
            for data, marks in zip(_bytes(batch.column("body"), packed=True), _lists(batch.column("marks"))):
                lo, hi = _unpacked(marks)
                steps = hi - lo + 1
                at = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps - lo, steps)
                parts.append(windows(_symbols(data, by_words), np.sort(at), length))
            yield _suffix_batch(batch, parts)

    return docs.mapInArrow(emit, _SUFFIX)


def _in_order(suffixes: DataFrame) -> DataFrame:
    """``(th, size, lo, hi, level)`` of suffixes that repeat: level 2 in all three keys (3: and it is the witness of its
    equals for open ones), level 1 in the first two keys only."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        keys = [table.column(c).to_numpy() for c in ("lead", "k1", "k2")]
        order, steps = multikey_order(keys)
        level = _repeats(steps[1]).astype(np.int32) + _repeats(steps[2]) + _witness(steps[1], steps[2])
        ends = np.unique([0, len(order) - 1])
        rows = np.concatenate([np.flatnonzero(level), ends])
        edge = np.arange(len(rows)) >= len(rows) - len(ends)
        out = table.select([*_TEXT, "lo", "hi"]).take(pa.array(order[rows]))
        out = out.append_column("level", pa.array(level[rows], pa.int32())).append_column("edge", pa.array(edge))
        for name, key in zip(("lead", "k1", "k2"), keys):
            out = out.append_column(name, pa.array(key[order[rows]], pa.int64(), mask=~edge))
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    count = tasks(suffixes.sparkSession, suffixes.count(), BUCKET_ROWS)
    marked = stored(suffixes.repartitionByRange(count, "lead", "k1", "k2", "th", "size", "lo").mapInArrow(sort, _MARKED))
    # Two rows of each bucket at most: equal ones in neighbouring buckets are compared here.
    edges = marked.where("edge").drop("level", "edge")
    grams = edges.groupBy("lead", "k1").agg(F.count("*").alias("n1"))
    spans = edges.groupBy("lead", "k1", "k2").agg(F.count("*").alias("n2"))
    across = edges.join(grams, ["lead", "k1"]).join(spans, ["lead", "k1", "k2"])
    level = F.when(F.col("n2") > 1, 3).when(F.col("n1") > 1, 1).otherwise(0)
    across = across.select(*_TEXT, "lo", "hi", level.alias("level"))
    return marked.where("not edge").select(*_TEXT, "lo", "hi", "level").union(across).where("level > 0")


def repeated_starts(docs: DataFrame, length: int, by_words: bool = False) -> DataFrame:
    """``(th, size, starts)``: for texts of ``docs (th, size, body)``, ranges ``lo..hi`` of starts of repeated windows
    of ``length`` bytes or words.

    A text is named by its 64-bit hash and its size, so that copies of it share one row; they all lose the same bytes.
    """
    sparse = stored(_anchor_rows(docs, length, by_words))
    marks = stored(_in_order(sparse))
    removed(sparse)
    pending = marks.where("level != 2").groupBy(*_TEXT).agg(F.collect_set(_range()).alias("marks"))
    opened = _packed(docs).join(pending, _TEXT)
    dense = stored(_window_rows(opened, length, by_words))
    both = marks.where("level >= 2").union(_in_order(dense).where("level >= 2"))
    return both.groupBy(*_TEXT).agg(F.collect_set(_range()).alias("starts"))


def cut(data: np.ndarray, starts: np.ndarray, length: int, word_starts: np.ndarray | None = None, words: int = 0) -> tuple[bytes, list[dict]]:
    """The bytes of a text outside its repeated windows of bytes and of words, and the removed runs. The white space
    between two words of one window goes with them."""
    word_starts = np.empty(0, np.int64) if word_starts is None else word_starts
    if not len(starts) and not len(word_starts):
        return data.tobytes(), []
    size = len(data) + 1
    lo, hi = _unpacked(starts)
    depth = np.bincount(lo, minlength=size) - np.bincount(hi + length, minlength=size)
    if len(word_starts):
        _, first, end = word_spans(data)
        lo, hi = _unpacked(word_starts)
        depth += np.bincount(first[lo], minlength=size) - np.bincount(end[hi + words - 1], minlength=size)
    gone = np.cumsum(depth)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
    return data[~gone].tobytes(), spans


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``kept_bytes`` (binary: the UTF-8 bytes that stay, in order) and ``removed_spans``
    (array of ``start, end`` byte ranges).

    If ``words`` is given, a run of that many words that also stands anywhere else goes too, whatever white space
    separates its words.

    A null or empty text has no bytes and loses none; a text shorter than ``length`` stays whole. Rows that repeat the
    same text are different documents, so each copy of at least ``length`` bytes is removed entirely, whatever their
    other columns hold. A cut may fall inside a character; the bytes are returned as they are. Columns of the input
    with the names of the new ones are replaced, all others are kept; an empty table gives an empty result.
    """
    docs = without(docs, "n_bytes", "kept_bytes", "removed_spans")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    named = [F.xxhash64(body).alias("th"), F.octet_length(body).cast("long").alias("size"), body.alias("body")]
    found = repeated_starts(docs.select(*named), length)
    rest = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("no text")).alias("row"), *named
    )
    if words:
        by_words = repeated_starts(docs.select(*named), words, True).withColumnRenamed("starts", "word_starts")
        found = found.join(by_words, _TEXT, "full")
    else:
        found = found.withColumn("word_starts", F.lit(None).cast("array<long>"))
    joined = _packed(rest).join(found, _TEXT, "left").select("row", "body", "starts", "word_starts")
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*joined.schema.fields[:2], StructField("n_bytes", LongType()), StructField("kept_bytes", BinaryType()), StructField("removed_spans", spans)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in _slices(batches):
            texts = list(_bytes(batch.column("body"), packed=True))
            starts = zip(_lists(batch.column("starts")), _lists(batch.column("word_starts")))
            done = [cut(d, s, length, w, words or 0) for d, (s, w) in zip(texts, starts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([d.tobytes() for d in texts], pa.binary()),
                    pa.array([len(d) for d in texts], pa.int64()),
                    pa.array([k for k, _ in done], pa.binary()),
                    pa.array([s for _, s in done], kind),
                ],
                schema.names,
            )

    out = joined.mapInArrow(emit, schema)
    text = F.when(~F.col("row").getField("no text"), F.col("body").cast("string"))
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*columns, "n_bytes", "kept_bytes", "removed_spans")
