"""Packing of token sequences into fixed-length training sequences by the sum-of-squares rule.

With N(g) the number of open sequences that have g places left, a piece goes where the sum of all N(g)² becomes smallest:
a new one is opened when no open one has room. Keeping the gaps spread over many sizes keeps a fitting one at hand.
Pieces of a group come longest first.

Pieces are dealt evenly over groups of bounded size, each packed in one task; only lengths matter, so token ids do not
travel. Sequences that a group leaves with room go through a second round of groups, in which the leftovers meet.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tablewarden.llm.common import removed, stored, without
from tablewarden.llm.tokens import Remembered, public_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces packed by one task.
GROUP_ROWS = 60_000
#: Texts whose new pieces are looked up together.
TEXTS_AT_ONCE = 500

_KNOWN: dict[str, _Words] = {}


#: Below this character, text is in normal form C as it is and every letter has one lower-case letter.
_SIMPLE = 0x130


def _splitter():
    """How this vocabulary's file splits simple lower-case text into words: contractions, letters, single digits,
    other visible characters."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(_SIMPLE)}
    letters = "".join(re.escape(chr(c)) for c in kind if kind[c] == "L")
    digits = "".join(re.escape(chr(c)) for c in kind if kind[c] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\t-\\r \x85\xa0{letters}{digits}]+").findall


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Words:
    """Ids (little-endian 32-bit) by word, for a vocabulary that drops white space and starts a new word at each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile("|".join([f"[^\\x00-{chr(_SIMPLE - 1)}]", *special])).search
        self.split = _splitter()
        self.known = Remembered(self._compute)

    def _compute(self, words: list[str]) -> Iterator[bytes]:
        letters = byte_letters()
        for w in words:
            spelled = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])
            yield np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at : at + TEXTS_AT_ONCE]
            split = [None if self.unusual(t) else self.split(t.lower()) for t in some]
            self.known.fill(chain.from_iterable(filter(None, split)))
            for text, words in zip(some, split):
                if words is None:
                    # Whole lines and words are independent; those that need the tokenizer's own rules go to it.
                    yield b"".join(self._unusual(piece) for piece in text.split(" "))
                else:
                    yield b"".join(map(self.known.__getitem__, words))

    def _unusual(self, piece: str) -> bytes:
        if self.unusual(piece):
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.split(piece.lower())
        return b"".join(self.known.get(w) or next(self._compute([w])) for w in words)


def encode_words(texts: list[str], path: str) -> Iterator[bytes]:
    if path not in _KNOWN:
        _KNOWN[path] = _Words(path)
    return _KNOWN[path].encode(texts)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; lengths are 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gap = capacity
        if size < capacity:
            # Cost of each gap size..capacity-1; the gap that becomes 0 is no open sequence any more. With the longest
            # first, a new sequence is opened only when no open one has room.
            before = count[size:capacity]
            cost = 2 * (count[: capacity - size] - before) + 2
            cost[0] = 1 - 2 * before[0]
            cost = np.where(before > 0, cost, np.iinfo(np.int64).max)
            best = int(cost.argmin())
            if before[best] > 0:
                gap = best + size
        if gap == capacity:
            where, used = used, used + 1
        else:
            where = open_with[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = where, capacity - gap
        left = gap - size
        if left:
            open_with[left].append(where)
            count[left] += 1
    return bins, offsets


_PIECES = [("doc_id", LongType()), ("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType())]


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int, ids: bool) -> DataFrame:
    """Pieces of the texts: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian)."""
    schema = StructType([StructField(n, t) for n, t in _PIECES] + [StructField("ids", BinaryType())] * ids)
    end = np.array([end_id], "<u4").tobytes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for key, raw in zip(keys, encode_words([t or "" for t in batch.column("text").to_pylist()], path)):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part), *([part] if ids else [])))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(emit, schema)


def _packed(pieces: DataFrame, groups: int, capacity: int, last: int) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and the fill of their sequence, packed in ``groups`` even groups."""
    schema = StructType(
        [*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("fill", LongType())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        lengths = table.column("length").to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        # Numbers of the two rounds are even and odd, and each group has a range of its own.
        numbers = (((TaskContext.get().partitionId() + 1) << 32) | bins) * 2 + last
        for name, column in (("sequence_id", numbers), ("offset", offsets), ("fill", fill)):
            table = table.append_column(name, pa.array(column, pa.int64()))
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    return pieces.repartition(groups).mapInArrow(pack, schema)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).

    A document is its token ids and one end id. Only those longer than ``capacity`` are cut, into pieces of
    ``capacity``; a null or empty text is the end id alone. Null and repeated ids and repeated rows are packed like
    any other row, each on its own; other columns are ignored; an empty table gives an empty result.
    ``tokenizer`` is the path of a vocabulary that drops white space.
    """
    pieces = stored(tokenized(docs, id_col, text_col, tokenizer or public_path(TOKENIZER), capacity, end_id, with_ids))
    count = pieces.count()
    groups = -(-count // GROUP_ROWS)
    out = pieces.columns + ["sequence_id", "offset"]
    if groups <= 1:
        return _packed(pieces, 1, capacity, 1).select(*out)
    first = stored(_packed(pieces, groups, capacity, 0))
    removed(pieces)
    # Sequences that have room after the first round are dissolved; their pieces meet in the second.
    short = first.where(F.col("fill") < capacity).select(*pieces.columns)
    again = _packed(short, -(-short.count() // GROUP_ROWS) or 1, capacity, 1)
    return first.where(F.col("fill") == capacity).select(*out).union(again.select(*out))
