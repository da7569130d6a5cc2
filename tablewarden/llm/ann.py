"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut in two halves and each half is quantised by a codebook of its own; the pair of codes is its cell. For a
query, a heap yields cells in order of summed distance of the two half-centroids until they hold enough vectors; only
those vectors are compared exactly, on the original values.

The codebooks are trained on a bounded sample (``SAMPLE_ROWS``), on which the share of vectors to visit is also set: the
smallest that finds ``recall`` of the sample's true neighbours. Every vector is indexed. Equal vectors are one entry
with the few smallest ids that a result can use, so a vector that a third of the rows share is compared once. Cells of
one first code, and the queries that visit them, are split into blocks of bounded size that meet in separate tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.runtime import materialize

#: Centroids of each half.
CENTROIDS = 32
#: Vectors that the codebooks are trained on, and of them those whose neighbours set the share to visit.
SAMPLE_ROWS = 40_000
SAMPLE_QUERIES = 400
#: Share of the true neighbours to find in the sample.
RECALL = 0.96
#: Distinct vectors that a query's cells hold at least.
VISITED_LEAST = 2000
#: Vectors or queries of one first code that meet in one task.
BLOCK = 2000
ROUNDS = 12
SEED = 5


def _trained(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        code = _codes(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        size = np.bincount(code, minlength=len(centres))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def _codes(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(points[i : i + 8192], centres).argmin(1) for i in range(0, len(points), 8192)])


def visits(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (code of the first half times the number of second codes, plus the second code) in order of summed
    distance, until they hold ``enough`` vectors; empty cells are passed over."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[one[0]] + second[two[0]], 0, 0)]
    seen, found, have = {(0, 0)}, [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]) * len(second) + int(two[j])
        if sizes[cell]:
            found.append(cell)
            have += int(sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))
    return found


def share_to_visit(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, k: int, recall: float) -> float:
    """Share of the sample that cells must hold, in visiting order, to contain ``recall`` of the true neighbours."""
    one, two = books
    cell = _codes(points[:, :half], one) * len(two) + _codes(points[:, half:], two)
    sizes = np.bincount(cell, minlength=len(one) * len(two))
    needs = []
    for i in np.random.default_rng(SEED).permutation(len(points))[:SAMPLE_QUERIES]:
        q = points[i : i + 1]
        order = visits(_distances(q[:, :half], one)[0], _distances(q[:, half:], two)[0], sizes, len(points))
        held = np.zeros(len(sizes), np.int64)
        held[order] = np.cumsum(sizes[order])
        d = _distances(points, q)[:, 0]
        d[i] = np.inf
        needs.append(held[cell[np.argsort(d)[:k]]])
    return float(np.quantile(np.concatenate(needs), recall)) / len(points) if needs else 1.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part: no null, not zero, all components finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    recall: float = RECALL,
    least: int = VISITED_LEAST,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: ``query_id, rank, vec_id, score`` (Euclidean distance).

    Candidates are all rows of ``vectors`` but the one with the query's id; ties go to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part, as query or candidate, nor do null ids; rows that
    repeat an id and vector count once. All vectors have one length. A query without candidates has no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"]).select(F.col("id").alias("query"), F.col("v").alias("q"))
    # Of equal vectors only the k + 1 smallest ids can be in a result (one may be the query itself).
    order = Window.partitionBy("v").orderBy("id")
    ranked = rows.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    total = entries.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return vectors.sparkSession.createDataFrame([], empty)
    sample = entries.select("v").sample(min(1.0, 1.2 * SAMPLE_ROWS / total), SEED).limit(SAMPLE_ROWS)
    points = _matrix(sample.toPandas()["v"]) if total > 100 else _matrix(entries.select("v").toPandas()["v"])
    half = max(1, points.shape[1] // 2)
    books = (_trained(points[:, :half], CENTROIDS, SEED), _trained(points[:, half:], CENTROIDS, SEED + 1)) if points.shape[1] > 1 else (_trained(points, CENTROIDS, SEED), np.zeros((1, 0)))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    wide = len(books[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = sent.value
        for batch in batches:
            if len(batch):
                m = _matrix(batch["v"])
                yield batch.assign(cell=_codes(m[:, :half], one) * wide + _codes(m[:, half:], two))

    index = materialize(entries.mapInPandas(place, "v array<double>, ids array<long>, cell int"))
    sizes = np.zeros(len(books[0]) * wide, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most CENTROIDS squared rows
        sizes[r["cell"]] = r["count"]
    enough = max(least, int(np.ceil(share_to_visit(points, books, half, k, recall) * total)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = sent.value
        for batch in batches:
            rows = []
            for query, q in zip(batch["query"].tolist(), batch["q"]):
                v = np.asarray(q)[None, :]
                seconds: dict[int, list[int]] = {}
                for cell in visits(_distances(v[:, :half], one)[0], _distances(v[:, half:], two)[0], sizes, enough):
                    seconds.setdefault(cell // wide, []).append(cell % wide)
                rows += [(query, q, c, s) for c, s in seconds.items()]
            yield pd.DataFrame(rows, columns=["query", "q", "first", "seconds"])

    probes = asked.mapInPandas(probe, "query long, q array<double>, first int, seconds array<int>")
    probes = materialize(probes)
    asked_of = {r["first"]: r["count"] for r in probes.groupBy("first").count().collect()}
    held_by = sizes.reshape(len(books[0]), wide).sum(1)
    blocks = vectors.sparkSession.createDataFrame(
        [(c, -(-int(n) // BLOCK), -(-asked_of.get(c, 1) // BLOCK)) for c, n in enumerate(held_by) if n], "first int, vb int, qb int"
    )

    def spread(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """Rows in one block of their own side, copied to every block of the other side."""
        out = df.join(F.broadcast(blocks), "first")
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        return out.withColumn(f"in_{own}", mine).withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("vb", "qb")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        points, ids, second, out = _matrix(left["v"]), left["ids"].tolist(), left["second"].to_numpy(), []
        for query, q, seconds in zip(right["query"].tolist(), right["q"], right["seconds"]):
            visited = np.zeros(wide, bool)
            visited[seconds] = True
            mine = np.flatnonzero(visited[second])
            if not len(mine):
                continue
            d = np.sqrt(((points[mine] - np.asarray(q)) ** 2).sum(1))
            last = min(k, len(d) - 1)
            top = np.flatnonzero(d <= np.partition(d, last)[last])
            best = heapq.nsmallest(k, ((d[i], j) for i in top.tolist() for j in ids[mine[i]] if j != query))
            out += [(query, j, s) for s, j in best]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    index = index.select("v", "ids", F.floor(F.col("cell") / wide).cast("int").alias("first"), (F.col("cell") % wide).alias("second"))
    left = spread(index, "vb", "qb", "v").groupBy("first", "in_vb", "in_qb")
    right = spread(probes, "qb", "vb", "query").groupBy("first", "in_vb", "in_qb")
    met = left.cogroup(right).applyInPandas(compare, "query long, id long, score double")
    by_query = Window.partitionBy("query").orderBy("score", "id")
    out = met.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
