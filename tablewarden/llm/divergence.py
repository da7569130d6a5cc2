"""Divergence of the sources of each language, and the terms that set a source apart, by hash-consed segment trees.

The kept terms of a language are numbered in their order. A group (a language's source) is a vector of counts over these
numbers, and its segment tree halves the numbers down to single terms. In a task, the trees of several groups over one
block of terms are built together and hash-consed: subtrees with the same counts are the same node, whichever group or
place they come from. Two trees are traversed at once from their roots; every level keeps each pair of nodes once, with
the number of places where it stands, so that equal pairs are priced once. A block in which both groups are all zero is the
same pair of nodes everywhere and is priced in one step at the end.

A probability is ``1 + floor(SCALE * (count + 2) / (N + 2 V))`` and the price of p and q ``floor((p - q)^2 / (p + q))``; all
of it is integers. Null texts have no terms, null languages and sources count as ''. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import removed, stored
from tablewarden.llm.ranks import ranked, same

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 10
#: Terms reported for each group.
TOP = 10
SCALE = 1_000_000_000
#: Terms of a block (a power of two) and groups whose trees meet in one task on each side.
BLOCK = 1024
GROUPS = 32
#: Entries of the counts that a task holds before it hands them on.
HELD = 200_000

#: Upper-case letters become lower-case ones, letters and bytes beyond ASCII stay, all else separates terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Count of a place beyond the last term.
_NONE = -1
#: Numbers of the rows that are no group: the whole language, and the mark that makes every pair appear.
_WHOLE, _MARK = -1, -2


def terms(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)`` from ``docs (text, lang, source)``; tasks add up before anything is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs) in held.items():
                names = list(count)
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(names)), pa.repeat(pa.scalar(source, pa.string()), len(names)), pa.array(names, pa.binary())]
                numbers = [pa.array([c[t] for t in names], pa.int64()) for c in (count, docs)]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], ["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = terms(text.as_py())
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(found)
                docs.update(set(found))
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    plain = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "lang", "source")
    each = plain.mapInArrow(add, "lang string, source string, term binary, count long, docs long")
    return each.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def probability(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` is N + 2 V."""
    if count.size and int(count.max()) > 9_000_000_000:
        return np.array([1 + SCALE * (int(c) + 2) // int(s) for c, s in zip(count, size)], np.int64)
    return 1 + SCALE * (count + 2) // size


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Trees:
    """Hash-consed segment trees over the rows of ``counts``, whose width is a power of two."""

    def __init__(self, counts: np.ndarray):
        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        #: Children of the nodes of each level, from the leaves up.
        self.children: list[np.ndarray] = []
        nodes = len(self.values)
        while ids.shape[1] > 1:
            both, ids_above = np.unique(ids[:, 0::2] * nodes + ids[:, 1::2], return_inverse=True)
            self.children.append(np.stack([both // nodes, both % nodes], axis=1))
            ids = ids_above.reshape(len(ids), -1)
            nodes = len(both)
        self.roots = ids[:, 0]

    def totals(self, one: np.ndarray, two: np.ndarray, leaf: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all places of ``leaf(pair, count, count)`` for every pair of rows ``one[i], two[i]``."""
        pair, x, y = np.arange(len(one)), self.roots[one], self.roots[two]
        times = np.ones(len(one), np.int64)
        for level in range(len(self.children) - 1, -1, -1):
            kids = self.children[level]
            nodes = len(self.children[level - 1]) if level else len(self.values)
            left, right = kids[x], kids[y]
            key = ((pair * nodes)[:, None] + left) * nodes + right
            met, at = np.unique(key.ravel(), return_inverse=True)
            summed = np.zeros(len(met), np.int64)
            np.add.at(summed, at, np.repeat(times, 2))
            pair, x, y, times = met // (nodes * nodes), met // nodes % nodes, met % nodes, summed
        out = np.zeros(len(one), np.int64)
        np.add.at(out, pair, leaf(pair, self.values[x], self.values[y]) * times)
        return out


def _compare(key: tuple, rows: pd.DataFrame, block_terms: int, set_groups: int) -> pd.DataFrame:
    """Prices of all pairs of groups of one or two sets of groups over one block, and candidates for the leading terms."""
    lang, block, i, j = key
    head = rows.iloc[0]
    v = int(head["v"])
    width = 0 if block < 0 else int(min(block_terms, v - block * block_terms))
    sizes = [np.asarray(head["sizes_i"], np.int64), np.asarray(head["sizes_j"], np.int64)]
    members = [i * set_groups + np.arange(len(sizes[0]))] + ([j * set_groups + np.arange(len(sizes[1]))] if j != i else [])
    groups = np.concatenate(members)
    size = np.concatenate(sizes[: len(members)]) + 2 * v
    one, two = np.triu_indices(len(groups), 1)
    if j != i:
        across = (one < len(members[0])) & (two >= len(members[0]))
        one, two = one[across], two[across]
    names = ["lang", "a", "b", "width", "value"]
    if not width:
        return pd.DataFrame({"lang": lang, "a": groups[one], "b": groups[two], "width": 0, "value": 0}, columns=names)

    found = np.zeros((len(groups) + 1, 1 << (width - 1).bit_length()), np.int64)
    found[:, width:] = _NONE
    place = {int(g): k for k, g in enumerate(groups)} | {_WHOLE: len(groups)}
    for g, at, n in zip(rows["idx"], rows["places"], rows["counts"]):
        if g != _MARK:
            found[place[int(g)], np.asarray(at, np.int64)] = n
    trees = Trees(found)

    def leaf(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = probability(np.maximum(x, 0), size[one[pair]])
        q = probability(np.maximum(y, 0), size[two[pair]])
        return np.where(x == _NONE, 0, price(p, q))

    out = [pd.DataFrame({"lang": lang, "a": groups[one], "b": groups[two], "width": width, "value": trees.totals(one, two, leaf)}, columns=names)]
    if i == j:
        out += _leading(lang, int(block) * block_terms, groups, size, found, width, int(head["whole"]) + 2 * v)
    return pd.concat(out, ignore_index=True)


def _leading(lang: str, first: int, groups: np.ndarray, size: np.ndarray, found: np.ndarray, width: int, whole_size: int) -> Iterator[pd.DataFrame]:
    """The ``TOP`` terms of a block that are more likely in a group than in its language; equal pairs of counts are priced once."""
    whole = found[-1, :width]
    for k, g in enumerate(groups):
        at = np.flatnonzero(found[k, :width])
        if not len(at):
            continue
        both, back = np.unique(np.stack([found[k, at], whole[at]]), axis=1, return_inverse=True)
        p = probability(both[0], np.full(both.shape[1], size[k]))
        q = probability(both[1], np.full(both.shape[1], whole_size))
        value = np.where(p > q, price(p, q), -1)[back.ravel()]
        best = np.lexsort((at, -value))[:TOP]
        best = best[value[best] >= 0]
        yield pd.DataFrame({"lang": lang, "a": g, "b": first + at[best], "width": _NONE, "value": value[best]})


def _zero_price(a: str, b: str) -> Column:
    """Price of a term that neither of two groups of N = ``a``, ``b`` has."""
    p, q = (f"(1 + {2 * SCALE}L div ({n} + 2 * v))" for n in (a, b))
    return F.when(F.col("v") > 0, F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")).otherwise(F.lit(0).cast("long"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, block_terms: int = BLOCK, set_groups: int = GROUPS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group its divergence from every other source of its language
    (part ``pair``), and up to ``TOP`` terms that are more likely in it than in its language (part ``term``).
    Only terms in ``least_docs`` documents of the language count. Tasks take ``block_terms`` terms of ``set_groups`` groups on each side."""
    docs = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counted = stored(counts(docs))
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs)
    vocabulary = stored(ranked(vocabulary.drop("docs"), ["lang"], ["term"]).withColumnsRenamed({"rank": "id", "group_rows": "v"}))
    langs = vocabulary.groupBy("lang").agg(F.sum("total").alias("whole"), F.count("*").alias("v"))
    known = stored(counted.join(vocabulary.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", "id", "count"))
    removed(counted)
    sizes = known.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    members = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "whole", "v"])
    members = stored(ranked(members, ["lang"], ["source"]).withColumnsRenamed({"rank": "idx", "group_rows": "groups"}))

    block, at = F.floor(F.col("id") / block_terms), (F.col("id") % block_terms).cast("int")
    lists = [F.collect_list(at).alias("places"), F.collect_list("count").alias("counts")]
    segments = known.join(members.select("lang", "source", "idx"), ["lang", "source"]).groupBy("lang", block.alias("block"), "idx").agg(*lists)
    chunk = F.floor(F.col("idx") / set_groups)
    chunks = members.groupBy("lang", "v", "whole", "groups", chunk.alias("c")).agg(F.sort_array(F.collect_list(F.struct("idx", "n")))["n"].alias("sizes"))
    chunks = stored(chunks.withColumn("chunks", F.ceil(F.col("groups") / set_groups)).drop("groups"))
    nothing = [F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("counts")]
    # Every set of groups meets every other: over each block that one of them has terms in, and once over none.
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    mine = segments.withColumn("c", chunk).unionByName(chunks.select("lang", "c", F.lit(-1).cast("long").alias("block"), F.lit(_MARK).cast("long").alias("idx"), *nothing))
    mine = mine.join(chunks.select("lang", "c", "chunks"), ["lang", "c"]).select("*", partner)
    mine = mine.select("lang", "block", "idx", "places", "counts", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"))
    total = vocabulary.select("lang", "id", F.col("total").alias("count")).groupBy("lang", block.alias("block")).agg(*lists)
    total = total.join(chunks.select("lang", "c"), "lang").select("lang", "block", F.lit(_WHOLE).cast("long").alias("idx"), "places", "counts", F.col("c").alias("i"), F.col("c").alias("j"))
    left = chunks.select("lang", F.col("c").alias("i"), "v", "whole", F.col("sizes").alias("sizes_i"))
    right = chunks.select("lang", F.col("c").alias("j"), F.col("sizes").alias("sizes_j"))
    tasks = mine.unionByName(total).join(left, ["lang", "i"]).join(right, ["lang", "j"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _compare(key, rows, block_terms, set_groups)

    priced = stored(tasks.groupBy("lang", "block", "i", "j").applyInPandas(compare, "lang string, a long, b long, width long, value long"))

    one = members.select("lang", F.col("idx").alias("a"), F.col("source").alias("source_a"), F.col("n").alias("n_a"), "v")
    two = members.select("lang", F.col("idx").alias("b"), F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    summed = priced.where(F.col("width") >= 0).groupBy("lang", "a", "b").agg(F.sum("width").alias("width"), F.sum("value").alias("value"))
    summed = summed.join(one, ["lang", "a"]).join(two, ["lang", "b"]).withColumn("value", F.col("value") + (F.col("v") - F.col("width")) * _zero_price("n_a", "n_b"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = summed.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item")))
    # Numbers of terms stand in the order of the terms.
    best = priced.where(F.col("width") == _NONE).select("lang", "a", F.col("b").alias("id"), "value")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "id"))).where(F.col("rank") <= TOP)
    best = best.join(one.select("lang", "a", F.col("source_a").alias("source")), ["lang", "a"]).join(vocabulary.select("lang", "id", F.col("term").alias("item")), ["lang", "id"])
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
