"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.runtime import ensure_checkpoint_dir

#: The white space that separates words, as the body of a character class (fixed values).
SPACE = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: lineage is cut,
    and a lost executor costs a reread only."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tablewarden-llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(stored_df: DataFrame) -> None:
    """Delete the files of ``stored`` once nothing reads them any more."""
    jvm = stored_df.sparkSession._jvm
    conf = stored_df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in stored_df.inputFiles()}:
        if "/tablewarden-llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Texts that a task holds in Python at a time.
TEXTS_AT_ONCE = 200


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, which bounds the copies that a task makes of its texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows of at most about ``per_task`` each, and no fewer than the shuffle default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_task))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, in any letter case."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: A key is hot if more than one row in so many has it; there are fewer hot keys than this number.
HOT_SHARE = 1_000


def joined_apart(many: DataFrame, few: DataFrame, on: list[str], rows_of_key: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has one row per key and in ``rows_of_key`` how many rows of ``many`` have it.

    Rows of hot keys stay where they are and meet a broadcast of fewer than ``HOT_SHARE`` rows; all other keys are dealt out.
    ``many`` is read twice.
    """
    limit = total // HOT_SHARE
    hot, cold = few.where(F.col(rows_of_key) > limit), few.where(F.col(rows_of_key) <= limit)
    apart = many.join(F.broadcast(hot), on)
    return apart.unionByName(many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how).select(*apart.columns))


#: Slots of a filter of keys: a table of at most ``SLOTS / 64`` rows, however many the keys are.
SLOTS = 1 << 24


def may_hold(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with the column ``may hold``: false only if its long ``key`` is not among those of ``keys``.

    Every key sets the bit of its slot, and a broadcast table of these bits marks rows where they lie. So large rows that no
    join needs are not moved; marked ones may still be others that share a slot, which the join itself tells apart.
    """
    slot = F.pmod(F.col(f"`{key}`"), F.lit(SLOTS))
    word, place = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    bits = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = df.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    return met.withColumn("may hold", F.coalesce(F.bit_get("bits", place) == 1, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], "`may hold`")
