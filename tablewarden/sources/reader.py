"""Reading datasets by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.functions.columns import normalize_missing
from tablewarden.sources.json_documents import read_documents

FORMATS = ("csv", "json", "parquet")


def format_of(path: str) -> str:
    """Format named by the lower-cased extension of a path."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in FORMATS:
        raise ValueError(f"Unsupported file format. Supported: {', '.join(FORMATS)}")
    return extension


def load_dataset(
    spark: SparkSession, path: str, format: str | None = None, schema: str | None = None
) -> DataFrame:
    """Read CSV (with header), JSON or Parquet, with NaN read as missing.

    CSV and JSON types are inferred, which costs a pass over the files; give ``schema`` for
    large inputs. A JSON document may span lines and be of any size (``read_documents``); ``format="jsonl"``
    reads one record per line without the pass that cuts documents.
    """
    kind = (format or format_of(path)).lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind == "json":
        df = read_documents(spark, path, schema)
    elif kind == "jsonl":
        df = reader.json(path)
    elif kind == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"Unsupported file format. Supported: {', '.join(FORMATS)}")
    return normalize_missing(df)
