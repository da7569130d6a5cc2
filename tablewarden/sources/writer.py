"""Writing cleaned data and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import col

PARTITION = "run_id"


def write_cleaned(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write cleaned data as CSV with a header, or as Parquet."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.csv(path, header=True)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("Unsupported sink format. Supported: csv, parquet")


def write_results(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write each result table under its name, partitioned by run.

    A repeated run replaces its own partition and no other.
    """
    for name, df in tables.items():
        typed = df.select(
            *[
                col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "void" else col(f.name)
                for f in df.schema
            ]
        )
        (
            typed.withColumn(PARTITION, F.lit(run_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PARTITION)
            .parquet(f"{path}/{name}")
        )


def read_results(spark, path: str, name: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df if run_id is None else df.where(F.col(PARTITION) == run_id)
