"""SimHash near-duplicate classes with pivot distance tables.

Every text gets a 64-bit fingerprint. Equal fingerprints are one class from the start, so copies are never paired.
Each distinct fingerprint carries a table row: its Hamming distances to many fixed reference fingerprints (pivots).
By the triangle inequality two fingerprints within ``max_distance`` bits differ by at most that much in every
coordinate, so a pair whose largest coordinate difference is greater is discarded; survivors are verified bit by bit.

Pairs meet in block keys: the 64 bits are cut into ``max_distance + SPARE`` blocks, and fingerprints within
``max_distance`` bits agree in at least ``SPARE`` whole blocks (pigeonhole). No link can be missed.
The pairs of a block key are compared by their table rows inside the join and only links leave it. Components are
found by repeated minimum-neighbour contraction over the links of distinct fingerprints, entirely on executors.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewarden.functions.runtime import materialize
from tablewarden.llm.common import SPACE, joined_apart, may_hold, slices, stored, without

BITS = 64
#: Blocks that two linked fingerprints share for certain.
SPARE = 3
PIVOTS = 16
PIVOT_SEED = 20240501

_WORDS = re.compile(rf"[^{SPACE}]+".encode())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 14
#: Two hashes of id and text that name a document.
KEYS = ("key one", "key two")
#: Names of documents or sets that a task remembers.
SEEN = 200_000


def pivots(count: int = PIVOTS, seed: int = PIVOT_SEED) -> list[int]:
    """Reference fingerprints, drawn once from a fixed seed."""
    draw = random.Random(seed)
    return [draw.getrandbits(BITS) for _ in range(count)]


def ones_per_bit(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, lowest first."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, runs: int) -> int:
    return int(np.packbits(2 * ones > runs, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text: XXH64 of each run of ``words`` words, majority per bit, ties to 0.
    Shorter texts are one run; a null text or one without words gives zero."""
    raw = (text or "").encode().translate(_LOWER)
    found = [m.span() for m in _WORDS.finditer(raw)]
    if not found:
        return 0
    plain = b" ".join(raw[a:b] for a, b in found)
    lengths = np.fromiter((b - a for a, b in found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    runs = max(1, len(found) - words + 1)
    firsts = starts[:runs].tolist()
    lasts = ends[words - 1 :].tolist() if len(found) >= words else [int(ends[-1])]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, runs, _CHUNK):
        ones += ones_per_bit(np.array([digest(plain[a:b], seed) for a, b in zip(firsts[at : at + _CHUNK], lasts[at : at + _CHUNK])], np.uint64))
    return majority(ones, runs)


def plain_words(text: str | None) -> list[bytes]:
    """The words that a fingerprint is made of."""
    return _WORDS.findall((text or "").encode().translate(_LOWER))


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fingerprint_bits") -> DataFrame:
    """``docs`` with the fingerprint of its text as a long (the 64 bits, read as signed)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t, words) for t in batch.column(text_col).to_pylist()]
            signed = pa.array(np.array(bits, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], [*batch.schema.names, name])

    docs = without(docs, name)
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return docs.mapInArrow(add, schema)


def _bits(*parts: tuple[int, int]) -> int:
    mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in parts)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _packed(refs: list[int]) -> Column:
    """Distances to up to eight pivots, one byte each, in a long: the row of the distance table that is shuffled."""
    parts = [F.shiftleft(_distance(F.col("fp"), F.lit(_signed(p))).cast("long"), 8 * i) for i, p in enumerate(refs)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def _coordinate(side: str, i: int) -> Column:
    return F.shiftright(F.col(f"{side}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127))


def links(distinct: DataFrame, max_distance: int = 2, n_pivots: int = PIVOTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) that differ in 1 to ``max_distance`` bits."""
    if max_distance < 1:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    n = max_distance + SPARE
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = list(zip(edges, edges[1:]))
    keys = list(combinations(range(n), SPARE))
    refs = pivots(n_pivots)
    key = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_bits(*[blocks[i] for i in parts]))).alias("part"))
                for k, parts in enumerate(keys)
            ]
        )
    )
    table = distinct.select("fp", *[_packed(refs[i : i + 8]).alias(f"t{i // 8}") for i in range(0, n_pivots, 8)])
    keyed = table.select("fp", *[c for c in table.columns if c != "fp"], key.alias("key")).select(*table.columns, "key.k", "key.part")
    a, b = keyed.alias("a"), keyed.alias("b")
    largest = [F.abs(_coordinate("a", i) - _coordinate("b", i)) <= max_distance for i in range(n_pivots)]
    met = a.join(
        b,
        (F.col("a.k") == F.col("b.k"))
        & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.fp") < F.col("b.fp"))
        & reduce(Column.__and__, largest)
        & (_distance(F.col("a.fp"), F.col("b.fp")) <= max_distance),
    )
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fp, component)`` for every fingerprint of ``labels (fp, label)`` that has a link: the smallest label
    reachable over ``pairs (a, b)``; null labels count only if there is no other.

    Each round hooks every node to the smallest node among its neighbours and its neighbours' roots
    (alternating large-star and small-star), so long chains shrink by a constant factor a round.
    """
    edges = materialize(pairs)
    if edges.isEmpty():
        return labels.select("fp", F.col("label").alias("component")).where("false")
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        down = large.toDF("v", "u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        edges = materialize(small.where("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # A star forest now: every node points at the smallest node of its component.
    member = edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
    member = member.union(edges.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())
    named = member.join(labels, "fp")
    smallest = named.groupBy("root").agg(F.min("label").alias("component"))
    return member.join(smallest, "root").select("fp", "component")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_distance: int = 2,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint_bits, component_id``.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. ``component_id`` is the
    smallest id reachable; ids that are null count only when a component has no other (then it is null). Repeated
    rows keep one row each. Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    prints = stored(
        with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", words).drop("text")
    )
    distinct = stored(prints.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min("doc_id").alias("label"), F.count("*").alias("copies")))
    parts = components(links(distinct.select("fp"), max_distance, n_pivots), distinct.drop("copies"))
    named = distinct.join(parts, "fp", "left").select(F.col("fp").alias("fingerprint_bits"), "copies", F.coalesce("component", "label").alias("component_id"))
    return joined_apart(prints, named, ["fingerprint_bits"], "copies", prints.count()).select("doc_id", "fingerprint_bits", "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_distance: int = 2,
    n_pivots: int = PIVOTS,
    similarity: float | None = None,
) -> DataFrame:
    """``docs`` with one row of every near-duplicate class: that of smallest id (null last), then of smallest hash.

    Two texts are linked by ``max_distance`` bits of their fingerprints. If ``similarity`` is given, they are instead
    linked by that Jaccard similarity of their sets of ``words``-word runs, exactly (see ``jaccard``).
    Rows that repeat both id and text are one document. All columns stay; an empty table stays empty.
    """
    key = [F.xxhash64(F.lit(i), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias(n) for i, n in enumerate(KEYS)]
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *key)
    if similarity is None:
        prints = stored(with_fingerprint(named, "text", words, "class").drop("text"))
        distinct = prints.select(F.col("class").alias("fp")).distinct().withColumn("label", F.col("fp"))
        parts = components(links(distinct.select("fp"), max_distance, n_pivots), distinct)
    else:
        from tablewarden.llm import jaccard

        prints, parts = jaccard.classes(named, words, similarity, max_distance, n_pivots)
        prints = prints.withColumnRenamed("s", "class")
    # Tasks add up the rows of a class before any of them move.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *KEYS)).alias("w")
    firsts = prints.groupBy("class").agg(first).join(parts.withColumnRenamed("fp", "class"), "class", "left")
    winners = firsts.groupBy(F.coalesce("component", "class").alias("group")).agg(F.min("w").alias("w")).select(*[f"w.`{k}`" for k in KEYS]).distinct()
    return _chosen(docs, key, text_col, prints, stored(winners))


def _chosen(docs: DataFrame, key: list[Column], text_col: str, prints: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of the ``winners``. Rows that surely win and stand once stay where they are; of the others, a task
    hands on a repeated row once, and its text compressed."""
    copies = prints.groupBy(*KEYS).count()
    doubtful = stored(copies.join(winners.withColumn("wins", F.lit(True)), list(KEYS), "left").where("wins is null or count > 1").select(*KEYS))
    row = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    named = may_hold(docs.select(*key, F.col(f"`{text_col}`").cast("binary").alias("body"), row), doubtful, KEYS[0])
    certain = named.where("not `may hold`").select("body", "row")
    named = named.where("`may hold`").drop("may hold")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(), set()
        for batch in slices(batches):
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [i for i, n in enumerate(names) if not (n in seen or seen.add(n))]
            if len(seen) > SEEN:
                seen.clear()
            some = batch.take(pa.array(fresh, pa.int64()))
            yield some.set_column(2, "body", pa.array([pack.compress(v.as_buffer()) if v.is_valid else None for v in some.column(2)], pa.binary()))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for some in slices(batches):
            yield some.set_column(0, "body", pa.array([unpack.decompress(v.as_buffer()) if v.is_valid else None for v in some.column(0)], pa.binary()))

    met = named.mapInArrow(emit, named.schema).join(winners, list(KEYS), "left_semi")
    same = Window.partitionBy(*KEYS).orderBy(KEYS[0])
    once = met.withColumn("copy no", F.row_number().over(same)).where(F.col("copy no") == 1).select("body", "row")
    out = certain.union(once.mapInArrow(back, once.schema))
    return out.select(*[F.col("body").cast("string").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def hex_digits(bits: Column) -> Column:
    """A signed 64-bit fingerprint as 16 lower-case hex digits, highest bit first."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
