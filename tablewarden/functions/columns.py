"""Column selection by type and the missing-value rules shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC_TYPES = INTEGRAL_TYPES + FRACTIONAL_TYPES
TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Types with a plain text form; arrays, maps, structs and binary have no column statistics.
PLAIN_TYPES = NUMERIC_TYPES + TEXT_TYPES + TIME_TYPES + (T.BooleanType,)


def quoted(name: str) -> str:
    """Column name safe to pass to ``F.col`` even with dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def columns_of(df: DataFrame, types: tuple, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, types) and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integers, floats and decimals; booleans are not numbers here."""
    return columns_of(df, NUMERIC_TYPES, exclude)


def integral_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, INTEGRAL_TYPES, exclude)


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, TEXT_TYPES, exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Text and boolean columns."""
    return columns_of(df, TEXT_TYPES + (T.BooleanType,), exclude)


def plain_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, PLAIN_TYPES, exclude)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TEXT_TYPES)


def type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def present(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    """The given names that exist in ``df``, in the given order."""
    known = set(df.columns)
    return [n for n in (names or []) if n in known]


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL so that one missing-value rule holds everywhere."""
    floats = set(columns_of(df, (T.FloatType, T.DoubleType)))
    if not floats:
        return df
    return df.select(
        *[
            F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    """Numeric column as double with NaN read as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def double_of(df: DataFrame, name: str) -> Column:
    """As ``as_double``, without the NaN test for columns that cannot hold one."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return as_double(name)
    return col(name).cast("double")


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
