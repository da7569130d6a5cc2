"""Links between texts whose sets of word runs (shingles) have at least a given Jaccard similarity, exactly.

Sets meet in the rarest of their shingles: under any fixed order, two sets of similarity ``t`` share one of the first
``n - ceil(t n) + 1`` shingles of each (prefix filter). Candidates of SimHash join them. First each set is compared with
the least set of every shingle it meets in; these links make most classes, and settle pairs that meet only in shingles of
two sets. Pairs that meet in a shingle of more sets and still lie in different classes
follow, unless sizes, places in the order or the distances to that least set (a pivot: Jaccard distance is a metric)
rule them out. Every candidate is verified by its shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tablewarden.llm import simhash
from tablewarden.llm.common import may_hold, removed, slices, stored, tasks

#: Texts whose shingles are counted to put frequent ones last: so many, and one in ``SAMPLE_EVERY`` of a larger table, so that a
#: shingle of a given number of texts is known at any size. The order only decides the cost, never the result.
SAMPLE_TEXTS = 4_000
SAMPLE_EVERY = 5
FREQUENT = 3
MOST_FREQUENT = 1_000_000
#: Pairs of one text that are compared in one task.
PAIRS_AT_ONCE = 1_000

#: Rounds with other leaders at most, and pairs for each row of a shared shingle that need no further round.
ROUNDS = 3
PAIRS_PER_ROW = 4
#: Shingles of one sorted range.
ROWS_PER_TASK = 400_000

_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` lower-case words, repeats included; a shorter text is one run."""
    found = simhash.plain_words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    take = min(words, len(h))
    out = np.zeros(len(h) - take + 1, np.uint64)
    for i in range(take):
        out += h[i : i + len(out)] * _FACTORS[i]
    return _spread(out)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct ``runs``, sorted."""
    return np.unique(runs(text, words))


def set_name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of their counts in the sample."""
    if not len(found):
        return found
    seen = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        seen = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, seen))][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words).view(np.int64), pa.int64())], ["token"])

    every = min(SAMPLE_EVERY, max(1, texts.count() // SAMPLE_TEXTS))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counted = sample.mapInArrow(emit, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    rows = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("count").to_numpy()[order]


def _prints(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(id, key one, key two, fp, s, n, first)`` of ``docs (id, text, key one, key two)``, each text being shingled once: SimHash,
    name and size of its set and the set's first shingles. A task gives the first shingles of a set once."""
    frequent, counts = _frequent(docs.select("text"), words)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))
    schema = StructType([*[f for f in docs.schema.fields if f.name != "text"], *[StructField(c, LongType()) for c in ("fp", "s", "n")], StructField("first", ArrayType(LongType()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            fp, s, n, first = [], [], [], []
            for text in batch.column("text"):
                h = runs(text.as_py(), words)
                found = np.unique(h)
                name = set_name(found)
                fp.append(simhash.majority(simhash.ones_per_bit(h), len(h)))
                s.append(name)
                n.append(len(found))
                first.append(None if name in seen else prefix(found, *shared.value, similarity).view(np.int64))
                seen.add(name)
                if len(seen) > simhash.SEEN:
                    seen.clear()
            numbers = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            kept = [batch.column(f.name) for f in schema.fields[:-4]]
            yield pa.RecordBatch.from_arrays([*kept, *numbers], schema.names)

    return docs.mapInArrow(emit, schema)


_MET = "token long, s long, n long, place long, leader long, leader_n long, leader_place long, sets long, members long"


def _meetings(prints: DataFrame) -> DataFrame:
    """``(token, s, n, place)`` of the first shingles that several sets have, with the least (``leader``), the number and a hash
    (``members``) of these sets.

    One exchange: ranges of (token, s), so that a shingle of many sets fills many tasks. Each task sorts its range, drops
    the shingles that stand once and names the leaders; the first and last shingle of a range are settled between ranges.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        token, s = (table.column(c).to_numpy() for c in ("token", "s"))
        order = np.lexsort((s, token))
        token, s = token[order], s[order]
        new = np.ones(len(order), bool)
        new[1:] = token[1:] != token[:-1]
        # Tasks that met copies of a set each gave its rows.
        once = new.copy()
        once[1:] |= s[1:] != s[:-1]
        order, token, new = order[once], token[once], new[once]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        edge = (group == 0) | (group == group[-1])
        members = np.bitwise_xor.reduceat(_spread(s[once].view(np.uint64)), start)[group].view(np.int64)
        sets = np.bincount(group)[group]
        keep = np.flatnonzero((sets > 1) | edge)
        rows, heads = order[keep], order[start[group[keep]]]
        out = [table.column(c).combine_chunks().take(pa.array(rows)) for c in ("token", "s", "n", "place")]
        out += [table.column(c).combine_chunks().take(pa.array(heads)) for c in ("s", "n", "place")]
        names = ["token", "s", "n", "place", "leader", "leader_n", "leader_place", "sets", "members", "edge"]
        yield from pa.table([*out, pa.array(sets[keep], pa.int64()), pa.array(members[keep]), pa.array(edge[keep])], names=names).to_batches(max_chunksize=100_000)

    rows = prints.where("first is not null").select("s", "n", F.posexplode("first").alias("place", "token"))
    rows = rows.select("token", "s", "n", F.col("place").cast("long").alias("place"))
    total = prints.agg(F.sum(F.size("first")).alias("n")).head()[0] or 0
    count = tasks(prints.sparkSession, total, ROWS_PER_TASK)
    marked = stored(rows.repartitionByRange(count, "token", "s").mapInArrow(lead, _MET + ", edge boolean"))
    edges = marked.where("edge").select("token", "s", "n", "place")
    shared = edges.groupBy("token").agg(F.min(F.struct("s", "n", "place")).alias("least"), F.count("*").alias("sets"), F.bit_xor(F.xxhash64("s")).alias("members")).where("sets > 1")
    least = [F.col(f"least.{c}").alias(to) for c, to in (("s", "leader"), ("n", "leader_n"), ("place", "leader_place"))]
    across = edges.join(shared, "token").select("token", "s", "n", "place", *least, "sets", "members")
    return marked.where("not edge").drop("edge").unionByName(across)


def _alike(met: DataFrame) -> DataFrame:
    """``met`` with the shingles that the same sets have as one ``token``, such as those of a common passage: how many (``shared``), and the
    places of the first (``start``) and last of them. All sets have one order, so these are the same two shingles in each."""
    token = F.xxhash64("members", "sets", "leader").alias("token")
    ends = [f(c).alias(to) for side in ("", "leader_") for f, c, to in ((F.min, f"{side}place", f"{side}start"), (F.max, f"{side}place", f"{side}place"))]
    return met.groupBy(token, "s", "n", "leader", "leader_n", "sets").agg(F.count("*").alias("shared"), *ends)


def _large_enough(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _places_allow(a: str, b: str, similarity: float, at: str = "place") -> Column:
    """Whether two sets that share a shingle may be similar by its places: what stands before it in one set can only be met before it in
    the other, and what stands after it only after it. All sets have one order, so this holds for every shared shingle."""
    n, place = (lambda side: F.col(f"{side}n")), (lambda side: F.col(f"{side}{at}"))
    most = F.least(place(a), place(b)) + 1 + F.least(n(a) - place(a) - 1, n(b) - place(b) - 1)
    return most >= F.lit(similarity / (1 + similarity)) * (n(a) + n(b)) - 1e-6


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """What the sizes of two sets and the first and last of their ``_alike`` shingles allow."""
    return _large_enough(f"{a}n", f"{b}n", similarity) & _places_allow(a, b, similarity) & _places_allow(a, b, similarity, "start")


def _with_text(pairs: DataFrame, side: str, texts: DataFrame) -> DataFrame:
    """``pairs`` with the packed text of one side; a text of many pairs is spread over several keys."""
    counts = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("salts"))
    mine = texts.withColumnRenamed("s", side).join(counts, side).select(side, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("body").alias(f"body_{side}"))
    salted = pairs.join(counts, side).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int")).drop("salts")
    return salted.join(mine, [side, "salt"]).drop("salt")


def _texts(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``(s, body)``: a compressed text of every set of ``pairs``."""
    needed = stored(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct())
    first = may_hold(prints, needed, "s").where("`may hold`").join(needed, "s", "left_semi").groupBy("s").agg(F.min(F.struct("key one", "key two")).alias("k"))
    first = stored(first.select("s", "k.key one", "k.key two"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(), set()
        for batch in slices(batches):
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            some = batch.take(pa.array([i for i, n in enumerate(names) if not (n in seen or seen.add(n))], pa.int64()))
            if len(seen) > simhash.SEEN:
                seen.clear()
            yield some.set_column(2, "body", pa.array([squeeze.compress(v.as_buffer()) if v.is_valid else None for v in some.column(2)], pa.binary()))

    bodies = docs.select("key one", "key two", F.col("text").cast("binary").alias("body"))
    bodies = may_hold(bodies, first, "key one").where("`may hold`").drop("may hold")
    bodies = bodies.mapInArrow(pack, bodies.schema).join(first, ["key one", "key two"])
    # Rows that repeat id and text may give a text more than once.
    return stored(bodies.groupBy("s").agg(F.any_value("body").alias("body")))


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """``(a, b, j)``: the exact similarity of the sets of ``pairs (a, b)``."""
    texts = _texts(pairs, docs, prints)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: dict[str, tuple[int, np.ndarray]] = {}

        def known(side: str, name: int, body: pa.Scalar) -> np.ndarray:
            if side not in last or last[side][0] != name:
                last[side] = name, shingles(unpack.decompress(body.as_py()).decode() if body.is_valid else None, words)
            return last[side][1]

        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for x, y, left, right in zip(a, b, batch.column("body_a"), batch.column("body_b")):
                one, two = known("a", x, left), known("b", y, right)
                both = len(np.intersect1d(one, two, assume_unique=True))
                out.append(both / max(1, len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "j"])

    both = _with_text(_with_text(pairs, "a", texts), "b", texts).select("a", "b", "body_a", "body_b")
    out = stored(both.mapInArrow(compare, "a long, b long, j double"))
    removed(texts)
    return out


def _merged(pairs: DataFrame) -> DataFrame:
    """One row for each pair of ``pairs (a, b, n_a, n_b, place_a, place_b, shared, apart)``: how many first shingles are shared (a row is one
    without ``shared``), the last places of these in both, and whether some row is ``apart``."""
    last = [F.max(c).alias(c) for c in ("place_a", "place_b")]
    shared = F.sum("shared") if "shared" in pairs.columns else F.count("*")
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(*last, shared.alias("shared"), F.max("apart").alias("apart"))


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct ``(a, b)`` of ``pairs``, as for ``_merged``, which may be
    similar by count: beyond these shared ones, a common shingle stands after the last of them in both sets, and after the first
    shingles of one set. A pair of which some row is ``apart`` is not similar."""
    rest = [F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1 for n in ("n_a", "n_b")]
    after = F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1)
    most = F.col("shared") + F.least(F.greatest(*rest), after)
    return _merged(pairs).where(~F.col("apart") & (most >= F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6)).select("a", "b")


def _sides(x: str, y: str, shared: str = "shared", apart: Column | None = None) -> list[Column]:
    """The columns of a pair that two rows of a token make, the lesser set first."""
    lesser = F.col(f"{x}s") < F.col(f"{y}s")
    sides = [F.when(lesser, F.col(f"{l}{c}")).otherwise(F.col(f"{r}{c}")).alias(to + side) for side, l, r in (("a", x, y), ("b", y, x)) for c, to in (("s", ""), ("n", "n_"), ("place", "place_"))]
    apart = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    return [*sides, F.col(shared).alias("shared"), apart.alias("apart")]


def _stars(parts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that make the components ``parts``: every set and the least of its component."""
    return parts.select(F.col("component").alias("a"), F.col("fp").alias("b")).where("a != b")


def _mixed(met: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``met`` whose token has sets of several classes, with their class ``c``, the ``main`` class and the number of its sets."""
    classed = stored(met.join(parts.withColumnRenamed("fp", "s"), "s", "left").withColumn("c", F.coalesce("component", "s")).drop("component"))
    sized = classed.groupBy("token", "c").count().groupBy("token")
    sized = sized.agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.max("count").alias("mains"), F.count("*").alias("kinds")).where("kinds > 1")
    out = stored(classed.join(sized.drop("kinds"), "token"))
    removed(classed)
    return out


def _more_leaders(met: DataFrame, tried: DataFrame, parts: DataFrame, labels: DataFrame, docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> tuple[DataFrame, ...]:
    """Rounds in which the sets outside the main class of a shingle are held against another, random member of it.

    A large group of variants, of which each is near to some of the others only, becomes one class this way without its pairs.
    Rounds only find links earlier: whatever they leave open is compared afterwards. A token whose sets are all of one class stays so,
    so each round takes only the rows that the last one left mixed. Returns the verified pairs, the components and the ``_mixed`` rows.
    """
    mixed = _mixed(met, parts)
    for turn in range(ROUNDS):
        # A row outside the main class meets all sets of its token.
        work = mixed.agg(F.sum(F.when(F.col("c") != F.col("main"), F.col("sets")).otherwise(0).cast("double")), F.sum("shared")).first()
        if not work[1] or work[0] <= PAIRS_PER_ROW * work[1]:
            break
        known = mixed.where("mains > 1")
        leads = known.where("c = main").groupBy("token").agg(F.min_by(F.struct("s", "n", "place", "start"), F.xxhash64("s", F.lit(turn))).alias("l"))
        pairs = known.where("c != main").join(leads, "token").where(_may_be_similar("", "l.", similarity))
        pairs = _possible(pairs.select(*_sides("", "l.")), similarity)
        new = verified(stored(pairs.join(tried, ["a", "b"], "left_anti")), docs, prints, words)
        links = new.where(F.col("j") >= similarity - 1e-9).select("a", "b")
        if links.isEmpty():
            break
        tried = stored(tried.unionByName(new))
        parts = stored(simhash.components(_stars(parts).union(links), labels))
        left, mixed = mixed, _mixed(mixed.drop("c", "main", "mains"), parts)
        removed(left)
    return tried, parts, mixed


def classes(docs: DataFrame, words: int, similarity: float, max_distance: int, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """For ``docs (id, text, key one, key two)``: ``(id, key one, key two, s)``, the set of every document, and
    ``(fp, component)`` for the sets (as ``fp``) that have a link."""
    near = F.col("j") >= similarity - 1e-9
    prints = stored(_prints(docs, words, similarity))
    met = _meetings(prints).where((F.col("sets") > 2) | (F.col("s") != F.col("leader")))
    met = stored(_alike(met))
    prints = prints.drop("first", "n")
    stars = met.where(F.col("s") != F.col("leader")).where(_may_be_similar("", "leader_", similarity))
    named = {"leader": "a", "s": "b", "leader_n": "n_a", "n": "n_b", "leader_place": "place_a", "place": "place_b"}
    stars = stars.select(*[F.col(c).alias(to) for c, to in named.items()], "shared", F.lit(False).alias("apart"), "sets")
    # A token of two sets is a pair as it is; all others are joined below.
    twos = stored(stars.where("sets = 2").drop("sets"))
    stars = _possible(stars.drop("sets"), similarity)
    sets = stored(prints.select("fp", "s").distinct())
    heads = stored(sets.groupBy("fp").agg(F.min("s").alias("head")))
    same = sets.join(heads, "fp").where("s != head").select(F.col("head").alias("a"), F.col("s").alias("b"))
    links = simhash.links(heads.select("fp"), max_distance, n_pivots)
    one, two = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    across = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = verified(stored(stars.union(same).union(across).where("a != b").distinct()), docs, prints, words)

    labels = sets.select(F.col("s").alias("fp")).distinct().withColumn("label", F.col("fp"))
    parts = stored(simhash.components(first.where(near).select("a", "b"), labels))
    first, parts, mixed = _more_leaders(met.where("sets > 2"), first, parts, labels, docs, prints, words, similarity)
    removed(met)
    # What is left: pairs that meet in a token of more than two sets and lie in different classes so far.
    away = first.select(F.col("a").alias("leader"), F.col("b").alias("s"), (1 - F.col("j")).alias("d"))
    mixed = stored(mixed.join(away, ["leader", "s"], "left").withColumn("d", F.when(F.col("s") == F.col("leader"), 0.0).otherwise(F.col("d"))))
    x, y = mixed.where("c != main").alias("x"), mixed.alias("y")
    # Every token of a pair counts here, so only what holds for the whole pair may be asked of a row.
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("y.c") == F.col("y.main")) | (F.col("x.s") < F.col("y.s")))
        & _may_be_similar("x.", "y.", similarity),
    )
    pairs = pairs.select(*_sides("x.", "y.", "x.shared", F.abs(F.col("x.d") - F.col("y.d")) > 1 - similarity + 1e-9))
    pairs = stored(_possible(pairs.unionByName(twos), similarity).join(first, ["a", "b"], "left_anti"))
    removed(mixed)
    if not pairs.isEmpty():
        parts = simhash.components(_stars(parts).union(verified(pairs, docs, prints, words).where(near).select("a", "b")), labels)
    return prints.drop("fp"), parts
