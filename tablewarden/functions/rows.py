"""Row numbers, and random orders of all rows of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import col
from tablewarden.functions.runtime import heavy_tasks, stored_evenly

ROUNDS = 8
# Bits of a generated row id that count the rows of a partition.
PARTITION_BITS = 33


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``row, own`` with rows numbered from 0 without gaps and ``own`` a struct of the columns, and
    the number of rows. The rows are stored once, so that numbers stay if a task is run again;
    the driver receives one count per partition."""
    own = F.struct(*[col(c) for c in df.columns]).alias("own")
    stored = stored_evenly(df.select(own), df).select(F.monotonically_increasing_id().alias("at"), "own")
    part = F.shiftright("at", PARTITION_BITS)
    counts = sorted((r["part"], r["n"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "part bigint, start bigint")
    local = F.col("at") - F.shiftleft("part", PARTITION_BITS)
    rows = stored.withColumn("part", part).join(F.broadcast(starts), "part")  # one row per partition
    return rows.select((F.col("start") + local).alias("row"), "own"), total


def _scrambled(values: np.ndarray, key: int) -> np.ndarray:
    x = (values + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def reordered(rows: np.ndarray, total: int, key: int) -> np.ndarray:
    """Places of ``rows`` in the random order of 0 … ``total`` - 1 that ``key`` stands for.

    A Feistel network over the next power of four is a bijection whatever its round function; a
    place beyond the last row goes through it again until it falls inside, which keeps it one.
    """
    half = np.uint64(max(1, ((total - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int(k) for k in np.random.default_rng(key).integers(1 << 62, size=ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_scrambled(right, k) & mask)
        return (left << half) | right

    place = network(rows.astype("uint64"))
    beyond = place >= np.uint64(total)
    while beyond.any():
        place[beyond] = network(place[beyond])
        beyond = place >= np.uint64(total)
    return place.astype("int64")


def with_partners(df: DataFrame, repeats: int, seed: int) -> DataFrame:
    """``row, own, repeat, partner``: every row ``repeats`` times, each time beside another row of
    the whole table. Within a repeat each row is partner once. An empty table gives no rows. The number
    of join partitions grows with the rows, so that what a task holds does not."""
    rows, total = numbered(df)
    tasks = heavy_tasks(df.sparkSession, total * repeats)

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series, repeat: pd.Series) -> pd.Series:
        found = np.empty(len(row), dtype="int64")
        for r in repeat.unique():
            at = (repeat == r).to_numpy()
            found[at] = reordered(row.to_numpy()[at], total, seed * 1000 + int(r))
        return pd.Series(found)

    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    sent = rows.select("row", F.col("own").alias("partner"), repeat)
    sent = sent.select(place("row", "repeat").alias("row"), "repeat", "partner")
    return rows.repartition(tasks, "row").join(sent.repartition(tasks, "row"), "row")
