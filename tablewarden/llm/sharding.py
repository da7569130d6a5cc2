"""Sharding of records by weighted rendezvous hashing of stable keys.

Every shard draws a number from (0, 1) by hashing the record's key with its own; ``-ln(u) / weight`` is an exponential
time, and the shard with the least time takes the record, so each gets its share by weight. A further shard only takes
records for which its own time is the least: no record moves between the others. Only key and weights decide.

All of it is DataFrame functions; a record needs no other record to find its shard. Slots inside shards come from
``ranks``, in the order of the key, so that neither a large shard nor a repeated key meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import without
from tablewarden.llm.ranks import ranked

#: Hex digits of the hash that make a shard's number: 52 bits, which a double holds exactly.
DIGITS = 13


def times(key: Column, weights: Sequence[float]) -> Column:
    """Array of ``(time, shard)`` of a record for every shard. A null key counts as an empty one."""
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("every shard needs a finite weight above 0")
    plain = F.coalesce(key.cast("string"), F.lit(""))

    def one(weight: Column, shard: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(plain, F.lit(":"), shard.cast("string"))), 1, DIGITS), 16, 10).cast("double")
        return F.struct((-F.log((drawn + 0.5) / float(16**DIGITS)) / weight).alias("time"), shard.alias("shard"))

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), one)


def assign(rows: DataFrame, key: str, weights: Sequence[float], further: float | None = None) -> DataFrame:
    """``rows`` with the number ``shard`` (0 to ``len(weights) - 1``) of the shard that takes each; with ``further``, the weight
    of one more shard, also ``grown_shard``. No row is moved for it. Other columns of these names are replaced."""
    n = len(weights)
    drawn = without(rows, "shard", "grown_shard", "_times").withColumn("_times", times(F.col(f"`{key}`"), [*weights, *([] if further is None else [further])]))
    out = drawn.withColumn("shard", F.array_min(F.slice("_times", 1, n))["shard"])
    if further is not None:
        out = out.withColumn("grown_shard", F.array_min("_times")["shard"])
    return out.drop("_times")


def place(rows: DataFrame, key: str, weights: Sequence[float], further: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``assign`` and the ``slot`` of each row in its shard: gapless from 0, ascending by key (nulls first), then by ``order``.
    Repeated rows keep a slot each; an empty table stays empty."""
    out = ranked(without(assign(rows, key, weights, further), "slot"), ["shard"], [key, *order])
    return out.withColumnRenamed("rank", "slot").drop("group_rows")


def moved(rows: DataFrame, key: str, before: Sequence[float], after: Sequence[float]) -> DataFrame:
    """``(from_shard, to_shard, n_rows)`` of the rows that change their shard when the weights change."""
    one = assign(rows, key, before).withColumnRenamed("shard", "from_shard")
    both = assign(one, key, after).withColumnRenamed("shard", "to_shard")
    return both.where("from_shard != to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def write(placed: DataFrame, path: str) -> None:
    """Parquet folders ``shard=N`` under ``path``, from the result of ``place``; the rows of a file stand in the order of their slots."""
    placed.sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
