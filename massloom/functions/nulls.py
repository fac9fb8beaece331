"""Null handling: NA tokens, extraction that gives null, key guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_tokens(c: Column, tokens: Iterable[str]) -> Column:
    """Null where the string is one of ``tokens``."""
    return F.when(~c.isin(list(tokens)), c)


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where the pattern or the group did not match."""
    return F.when(c.rlike(pattern), F.nullif(F.regexp_extract(c, pattern, group), F.lit("")))


def literal_pattern(text: str) -> str:
    """A Java regex that matches ``text`` itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def literal_split(c: Column, delim: str) -> Column:
    """Split at a literal delimiter; empty tokens stay."""
    return F.split(c, literal_pattern(delim), -1)


def zero_to_null(c: Column) -> Column:
    """X <= 0 and null give null, others a double; NaN is kept."""
    x = c.cast("double")
    return F.when(x > 0, x)


def minus_to_null(c: Column) -> Column:
    """E7."""
    return F.nullif(c, F.lit("-"))


def flag(c: Column, true: Iterable[str] = ("+", "True"), false: Iterable[str] = ("", "False")) -> Column:
    """A boolean of its spellings; null and unknown spellings follow ``false`` and null."""
    return F.when(c.isin(list(true)), True).when(c.isin(list(false)), False)


def fill_flags(df: DataFrame) -> DataFrame:
    """Null to false in every boolean column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.fillna(False, subset=names) if names else df


def assert_no_null_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df``, failing when it is computed if a key is null."""
    for k in keys:
        df = df.withColumn(k, not_null(F.col(k), f"null in key column {k}"))
    return df


def not_null(c: Column, message: str = "null in a column that must have none") -> Column:
    """C4: the column, failing when it is computed on a null."""
    return F.coalesce(c, F.raise_error(F.lit(message)))
