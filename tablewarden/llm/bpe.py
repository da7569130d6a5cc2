"""Byte-level BPE encoding by speculation and verification, and decoding.

For every distinct word, greedy longest match proposes tokens. A proposal is the exact result if each of its tokens is
what merging makes of that token's own bytes and every adjacent pair is compatible: no merge across the seam would have
come before the merges that built the two tokens. All adjacent pairs of a batch are tested at once on arrays; only the
words with a failing pair are merged exactly, step by step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tablewarden.llm.common import without
from tablewarden.llm.packing import byte_letters
from tablewarden.llm.tokens import Remembered, public_path

TOKENIZER = "byte_bpe_50k.json"
TEXTS_AT_ONCE = 300
REMEMBERED = 500_000

#: Text below this character is split here; other text is split by the tokenizer's own pre-tokenizer.
_SIMPLE = 0x130
_NEVER = np.iinfo(np.int64).max
_KNOWN: dict[str, Vocabulary] = {}


class Vocabulary:
    """Tokens, merges and merge trees of a byte-level BPE file, and the words encoded so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        ids = model["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = token_bytes(path)
        self.single = {self.bytes[i][0]: i for text, i in ids.items() if text not in self.special and len(text) == 1}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.rank_of = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.made = [token for _, token in self.merge.values()]
        self._spines(len(ids))
        size = len(ids)
        codes = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(codes)
        self.size, self.codes = size, codes[order]
        self.code_rank = np.array([rank for rank, _ in self.merge.values()], np.int64)[order]
        # Tokens that merging reaches from their own bytes; others are never proposed.
        self.proposable: dict[bytes, int] = {}
        for i, raw in self.bytes.items():
            if i not in self.special.values() and (len(raw) == 1 or self.merged(raw) == [i]):
                self.proposable[raw] = i
        self.longest: dict[bytes, int] = {}
        for raw in self.proposable:
            self.longest[raw[:2]] = max(self.longest.get(raw[:2], 1), len(raw))
        self.pairs: dict[int, bool] = {}
        special = [re.escape(s) for s in self.special]
        self.unusual = re.compile("|".join([f"[^\\x00-{chr(_SIMPLE - 1)}]", *special])).search
        self.at_special = re.compile(f"({'|'.join(special)})").split if special else None
        self.split = _splitter()
        self.words = Remembered(self._encode_words, REMEMBERED)

    def _spines(self, size: int) -> None:
        """For every token, the nodes of its merge tree along its right and its left edge, from the token down, each
        with the rank of the merge that used it up inside the token."""
        parts = {made: (a, b, rank) for (a, b), (rank, made) in reversed(self.merge.items())}
        depth = 1
        sides: list[list[list[tuple[int, int]]]] = [[], []]
        for token in range(size):
            for side in (0, 1):
                node, used, nodes = token, _NEVER, []
                while True:
                    nodes.append((node, used))
                    if node not in parts:
                        break
                    a, b, used = parts[node]
                    node = b if side == 0 else a
                sides[side].append(nodes)
                depth = max(depth, len(nodes))
        self.depth = depth
        self.spine = np.full((2, size, depth), -1, np.int64)
        self.used = np.full((2, size, depth), -1, np.int64)
        for side in (0, 1):
            for token, nodes in enumerate(sides[side]):
                for d, (node, used) in enumerate(nodes):
                    self.spine[side, token, d], self.used[side, token, d] = node, used

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens ``left`` and ``right`` stay apart when merged side by side.

        A merge of a right-edge node x of the left token with a left-edge node y of the right one breaks the pair if its
        rank is lower than that of the merge that used x, and not higher than that of the merge that used y (of equal
        merges the leftmost goes first)."""
        fine = np.ones(len(left), bool)
        for i in range(self.depth):
            x, x_used = self.spine[0, left, i], self.used[0, left, i]
            if not (x >= 0).any():
                break
            for j in range(self.depth):
                y, y_used = self.spine[1, right, j], self.used[1, right, j]
                live = np.flatnonzero(fine & (x >= 0) & (y >= 0))
                if not len(live):
                    break
                code = x[live] * self.size + y[live]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where(self.codes[at] == code, self.code_rank[at], _NEVER)
                fine[live[(rank < x_used[live]) & (rank <= y_used[live]) & (rank < _NEVER)]] = False
        return fine

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end = [], 0, len(word)
        find, longest = self.proposable.get, self.longest.get
        while at < end:
            size = min(longest(word[at : at + 2], 1), end - at)
            while (token := find(word[at : at + size])) is None:
                size -= 1
            out.append(token)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the merge of lowest rank, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        if len(ids) > 256:
            return self._merged_long(ids)
        rank_of, made = self.rank_of, self.made
        ranks = [rank_of.get(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            at = ranks.index(rank)
            ids[at : at + 2] = [made[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of.get((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of.get((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges over a linked list, for very long words."""
        from heapq import heapify, heappop, heappush

        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive: list[int | None] = list(ids)
        heap = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if alive[i] != a or j >= len(ids) or alive[j] != b:
                continue
            alive[i], alive[j] = self.merge[a, b][1], None
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else len(ids)
                if y < len(ids) and (alive[x], alive[y]) in self.merge:
                    heappush(heap, (self.merge[alive[x], alive[y]][0], x, alive[x], alive[y]))
        return [t for t in alive if t is not None]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        special = {"\0" + s: [i] for s, i in self.special.items()}
        raw = [w.encode() for w in words]
        tokens = [special.get(w) or self.proposed(r) for w, r in zip(words, raw)]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(tokens)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self._tested(codes)[back] if len(codes) else np.empty(0, bool)
        failing = np.unique(word[inner[~fine]])
        for i in failing.tolist():
            tokens[i] = self.merged(raw[i])
        for t in tokens:
            yield np.array(t, "<i4").tobytes()

    def _tested(self, codes: np.ndarray) -> np.ndarray:
        new = np.array([c for c in codes.tolist() if c not in self.pairs], np.int64)
        if len(new):
            if len(self.pairs) + len(new) > 200_000:
                self.pairs.clear()
                new = codes
            self.pairs.update(zip(new.tolist(), self.compatible(new // self.size, new % self.size).tolist()))
        return np.fromiter(map(self.pairs.__getitem__, codes.tolist()), bool, len(codes))

    def words_of(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token is a word of its own, marked by a null in front."""
        if not any(s in text for s in self.special) if text.isascii() else not self.unusual(text):
            return self.split(text)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        out: list[str] = []
        # Between a visible character and a single space the pre-tokenizer always cuts.
        for piece in re.split(r"(?<=\S)(?= \S)", text):
            if not self.unusual(piece):
                out += self.split(piece)
                continue
            for part in self.at_special(piece) if self.at_special else [piece]:
                if part in self.special:
                    out.append("\0" + part)
                elif part:
                    spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                    out += [bytes(byte_of[c] for c in w).decode() for w, _ in spelled]
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [self.words_of(t) for t in texts[at : at + TEXTS_AT_ONCE]]
            self.words.fill(chain.from_iterable(split))
            for words in split:
                yield b"".join(map(self.words.__getitem__, words))


_BYTES: dict[str, dict[int, bytes]] = {}


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every token id of a byte-level BPE file; special tokens are their own text."""
    if path not in _BYTES:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        found = {i: bytes(byte_of[c] for c in text) for text, i in file["model"]["vocab"].items() if i not in special}
        _BYTES[path] = found | special
    return _BYTES[path]


def decoded(ids: list[int], table: dict[int, bytes]) -> str:
    """Text of some ids; ids that are no token are left out, bytes that are no UTF-8 become U+FFFD."""
    try:
        raw = b"".join(map(table.__getitem__, ids))
    except KeyError:
        raw = b"".join(table.get(i, b"") for i in ids)
    return raw.decode(errors="replace")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, to bound what a worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _splitter():
    """The pre-tokenizer's pattern for simple text: contractions, letters, digits or other visible characters with at
    most one space in front, then white space, of which the last before a word stays apart."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(_SIMPLE)}
    letters = "".join(re.escape(chr(c)) for c in kind if kind[c] == "L")
    digits = "".join(re.escape(chr(c)) for c in kind if kind[c] == "N")
    white = "\\t-\\r \\x85\\xa0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+"
    ).findall


def vocabulary(path: str) -> Vocabulary:
    if path not in _KNOWN:
        _KNOWN[path] = Vocabulary(path)
    return _KNOWN[path]


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids (array of int) of its text.

    A null or empty text has no ids (an empty array). Special tokens spelled out in a text are recognised as such.
    A column called ``name`` is replaced; all other columns and repeated rows stay.
    """
    path = tokenizer or public_path(TOKENIZER)
    docs = without(docs, name)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in _slices(batches):
            found = list(vocab.encode([t or "" for t in batch.column(text_col).to_pylist()]))
            ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(emit, schema)


def decode(rows: DataFrame, ids_col: str = "ids", tokenizer: str | None = None, name: str = "decoded") -> DataFrame:
    """``rows`` with the text of its token ids; null ids give a null text."""
    path = tokenizer or public_path(TOKENIZER)
    rows = without(rows, name)
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in _slices(batches):
            texts = [None if not v.is_valid else decoded(v.values.to_numpy(zero_copy_only=False).tolist(), table) for v in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(emit, schema)
