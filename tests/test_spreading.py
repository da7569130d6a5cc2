from pyspark.sql import functions as F

from catalog import profile_queries
from catalog.base import table
from tablewarden.functions import runtime
from tablewarden.functions.rows import with_partners
from tablewarden.operators import leakage, models
from tests.conftest import SMALL


def in_one_partition(spark, rows):
    """Many partitions, only one of which has rows, like the scan of a file with one row group."""
    return spark.range(rows).withColumn("part", F.lit(0)).repartition(16, "part").select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") * 0.5).alias("y")
    )


def held(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_partition_are_dealt_out(spark):
    stored = models.assemble(in_one_partition(spark, 8_000), "y", problem="regression").data
    counts = held(stored)
    assert sum(counts) == 8_000 and max(counts) <= 2 * 8_000 / spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    counts = held(runtime.spread_out(runtime.materialize(in_one_partition(spark, 8_000))))
    assert sum(counts) == 8_000 and max(counts) <= 200


def test_partners_of_many_rows_meet_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    counts = held(with_partners(in_one_partition(spark, 2_000), 3, 1))
    assert sum(counts) == 6_000 and max(counts) <= 400


def test_numbers_of_few_values_are_informative_by_value(spark):
    # Even values mean a high target: deciles of 40 values mix even and odd ones.
    df = spark.range(4_000).select(((F.col("id") % 40)).cast("double").alias("x"), ((F.col("id") % 2) * 1000 + F.col("id") / 4000).alias("y"))
    found = leakage.numeric_information(df, "y").first()["mutual_information"]
    assert found > 0.69


def test_json_arrays_grow_in_number_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(profile_queries, "ARRAY_BYTES", 50_000)
    paths = []
    real = profile_queries.load_dataset
    monkeypatch.setattr(profile_queries, "load_dataset", lambda s, path, **more: paths.append(path) or real(s, path, **more))
    found = profile_queries.scan_json(spark, SMALL)
    assert found.count() == table(spark, SMALL, "documents").count()
    files = spark.read.text(paths[0]).select(F.input_file_name()).distinct().count()
    assert files > 4


def test_rows_are_dealt_out_before_they_are_stored(spark, monkeypatch):
    written = []
    real = runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda df: written.append(real(df)) or written[-1])
    stored = models.assemble(in_one_partition(spark, 8_000), "y", problem="regression").data
    assert stored.count() == 8_000 and len(written) == 1
    assert max(held(written[0])) <= 2 * 8_000 / spark.sparkContext.defaultParallelism
