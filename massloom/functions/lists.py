"""Delimited lists in strings: expansion, distinct tokens, unions, match counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import literal_split


def expand_delim_column(df: DataFrame, list_col: str, key_cols: str | Sequence[str], elem_col: str | None = None, delim: str = ";") -> DataFrame:
    """(keys, elem), one row per token; a null list gives one null, empty tokens stay.

    ``elem_col`` is ``list_col`` without its last "s" by default.
    """
    if elem_col is None:
        if not list_col.endswith("s"):
            raise ValueError(f"no name for the elements of {list_col}")
        elem_col = list_col[:-1]
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return df.select(*keys, F.explode_outer(literal_split(F.col(list_col), delim)).alias(elem_col))


def unique_tokens(c: Column, delim: str = ";") -> Column:
    """D3 as an aggregate: sorted distinct tokens of all strings of the group, nulls skipped.

    Strings are made distinct before they are gathered, so the state grows with the distinct strings.
    """
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(c), lambda s: literal_split(s, delim)))))


def rejoin_unique_tokens(c: Column, delim: str = ";", join_delim: str | None = None) -> Column:
    """D4 as an aggregate: sorted distinct tokens, joined again."""
    return F.array_join(unique_tokens(c, delim), delim if join_delim is None else join_delim)


def union_tokens(c: Column, splitter: str = ";") -> Column:
    """As D4, with one delimiter for both."""
    return rejoin_unique_tokens(c, splitter)


def n_matches(c: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(c, F.lit(pattern))
