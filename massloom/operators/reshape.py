"""Reshaping: level tables, pivot, melt, tensors, nested maps."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import not_null
from .ids import dense_rank_table


# --- categories: a level table (value, code) beside a plain string column

def level_table(df: DataFrame, col: str, levels: Sequence[str] | None = None) -> DataFrame:
    """(value, code) from 1, in the given order or sorted."""
    if levels is not None:
        return df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(levels, 1)], "value string, code long")
    return dense_rank_table(df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct(), ["value"], "code")


def encode(df: DataFrame, col: str, levels: DataFrame, code_col: str | None = None) -> DataFrame:
    """Adds the code; a value that is not among the levels is an error when computed."""
    code_col = code_col or f"{col}_code"
    joined = df.join(levels.select(F.col("value").alias("_value"), F.col("code").alias(code_col)), F.col(col) == F.col("_value"), "left").drop("_value")
    bad = F.col(col).isNotNull() & F.col(code_col).isNull()
    return joined.withColumn(code_col, F.when(bad, F.raise_error(F.concat(F.lit(f"{col} is not among the levels: "), F.col(col))).cast("long")).otherwise(F.col(code_col)))


def match_levels(dest: Mapping[str, DataFrame], src: Mapping[str, DataFrame], cols: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """dest's level tables with those of src for the same columns (or ``cols``)."""
    return {c: src[c] if c in src and (cols is None or c in cols) else t for c, t in dest.items()}


def decode(df: DataFrame, code_col: str, levels: DataFrame, col: str) -> DataFrame:
    """Back from codes to values."""
    return df.join(levels.select(F.col("code").alias(code_col), F.col("value").alias(col)), code_col, "left")


def to_nonnull(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4."""
    return df.withColumns({c: not_null(F.col(c), f"null in {c}") for c in cols})


# --- pivot and melt

def unstack(
    df: DataFrame, row_keys: str | Sequence[str], col_key: str, values: Sequence[str], levels: Sequence | None = None, sep: str = "_",
    name: Callable[[str, str], str] | None = None, group_by: str = "colkey",
) -> DataFrame:
    """Pivot of several values; columns are named value_colkey and ordered by key (default) or by value.

    Give ``levels`` where they are known: without, one pass finds the distinct keys.
    """
    if group_by not in ("colkey", "value"):
        raise ValueError(f"columns are grouped by colkey or value, not {group_by}")
    keys = [row_keys] if isinstance(row_keys, str) else list(row_keys)
    if levels is None:
        levels = [r[0] for r in df.select(col_key).where(F.col(col_key).isNotNull()).distinct().orderBy(col_key).collect()]
    name = name or (lambda value, key: f"{value}{sep}{key}")
    wide = df.groupBy(*keys).agg(*[F.first(F.when(F.col(col_key) == k, F.col(v)), ignorenulls=True).alias(name(v, str(k))) for k in levels for v in values])
    order = [(v, k) for k in levels for v in values] if group_by == "colkey" else [(v, k) for v in values for k in levels]
    return wide.select(*keys, *[F.col(f"`{name(v, str(k))}`") for v, k in order])


MEASURE = r"^(?P<value>[^.]+)\.(?P<var>[^.]+)$"


def pivot_longer(df: DataFrame, id_cols: Sequence[str] | None = None, pattern: str = MEASURE, var_col: str = "var", measures: Mapping[str, str] | None = None) -> DataFrame:
    """Melt of several measures; ``pattern`` has the groups value and var.

    Every measure must have the same set of vars.  Without a match the id columns alone remain.
    """
    found: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if m := re.match(pattern, c):
            found.setdefault(m["value"], {})[m["var"]] = c
    ids = list(id_cols) if id_cols is not None else [c for c in df.columns if not re.match(pattern, c)]
    keep = [F.col(f"`{c}`") for c in ids]
    if not found:
        warnings.warn("no column matches the pattern of measures", stacklevel=2)
        return df.select(*keep)
    variables = list(dict.fromkeys(v for cols in found.values() for v in cols))
    for value, cols in found.items():
        if set(cols) != set(variables):
            raise ValueError(f"measure {value} lacks {sorted(set(variables) - set(cols))}")
    rows = [F.struct(F.lit(v).alias(var_col), *[F.col(f"`{found[m][v]}`").alias(m) for m in found]) for v in variables]
    long = df.select(*keep, F.explode(F.array(*rows)).alias("_row"))
    return long.select(*keep, f"_row.{var_col}", *[F.col(f"_row.`{m}`").alias((measures or {}).get(m, m)) for m in found])


def pivot_ptms_longer(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """C14: the var may hold dots."""
    return pivot_longer(df, id_cols, r"^(?P<value>[^.]+)\.(?P<var>.+)$", "ptm_type")


def pivot_runs_longer(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Columns metric.[ix] raw, to rows by run."""
    long = pivot_longer(df, id_cols, r"^(?P<value>[^.]+)\.(?P<var>\[\d+\]\s.+)$", "_run")
    return long.select(*[c for c in long.columns if c != "_run"], F.regexp_extract("_run", r"^\[(\d+)\]", 1).cast("int").alias("rawfile_ix"), F.regexp_extract("_run", r"^\[\d+\]\s(.+)$", 1).alias("rawfile"))


# --- tensors: axis frames and cells

def array_to_frame(df: DataFrame, array_col: str, axes: Sequence[str], data_col: str = "signal") -> DataFrame:
    """Nested arrays to one row per cell; ``axes`` names the 1-based index of each dimension, outermost first."""
    keep = [c for c in df.columns if c != array_col]
    out, cell = df, array_col
    for k, axis in enumerate(axes):
        last = data_col if k == len(axes) - 1 else f"_cell{k}"
        out = out.select(*keep, *axes[:k], F.posexplode(cell).alias(axis, last)).withColumn(axis, (F.col(axis) + 1).cast("long"))
        cell = last
    return out


def axis_frame(df: DataFrame, cols: Sequence[str], ix: str) -> DataFrame:
    """Distinct key combinations of an axis with their 1-based index; no column is an axis of size 1."""
    if not cols:
        return df.sparkSession.range(1).select(F.lit(1).cast("long").alias(ix))
    return dense_rank_table(df.select(*cols).distinct(), list(cols), ix)


def frame_to_array(df: DataFrame, axes: Sequence[Sequence[str]], data_col: str | None = "signal", missed: object = None, default: object = None, order_col: str | None = None) -> DataFrame:
    """Dense cells, one row per combination of the axes' keys, with value ``data``.

    ``missed`` stands for nulls in the data, ``default`` for cells without a row; without ``data_col`` cells
    are true where a row is.  Of several rows of a cell the last in ``order_col`` counts.
    """
    keys = [c for a in axes for c in a]
    value = F.lit(True) if data_col is None else F.col(data_col) if missed is None else F.coalesce(F.col(data_col), F.lit(missed))
    rows = df.select(*keys, value.alias("data"), (F.lit(0) if order_col is None else F.col(order_col)).alias("_o"))
    cells = rows.groupBy(*keys).agg(F.max_by(F.struct("data"), "_o")["data"].alias("data"), F.lit(True).alias("_there"))
    dense = None
    for a in axes:
        axis = df.select(*a).distinct() if a else df.sparkSession.range(1).select()
        dense = axis if dense is None else dense.crossJoin(axis)  # the result has every combination
    met = None
    right = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], "data", "_there")
    for k in keys:
        same = dense[k].eqNullSafe(right[f"_{k}"])
        met = same if met is None else met & same
    joined = dense.join(right, met, "left") if met is not None else dense.crossJoin(right)
    fill = F.lit(False) if data_col is None and default is None else F.lit(default)
    return joined.select(*keys, F.when(F.col("_there"), F.col("data")).otherwise(fill).alias("data"))


def nested_array(cells: DataFrame, row_keys: Sequence[str], col_keys: Sequence[str], data_col: str = "data") -> DataFrame:
    """Rows of a dense matrix as arrays, in the order of the column keys."""
    items = F.array_sort(F.collect_list(F.struct(*col_keys, F.col(data_col).alias("_d"))))
    return cells.groupBy(*row_keys).agg(F.transform(items, lambda x: x["_d"]).alias(data_col))


# --- tuples and nested maps

def tuple_col(*cols: str) -> Column:
    """C16."""
    return F.struct(*cols)


def unnest(df: DataFrame, map_col: str, outer: str = "outer", inner: str = "inner", value: str = "value", key: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """C17: map of maps to rows by (outer, inner), or by one key made of both."""
    keep = [c for c in df.columns if c != map_col]
    rows = df.select(*keep, F.explode(map_col).alias(outer, "_inner")).select(*keep, outer, F.explode("_inner").alias(inner, value))
    return rows if key is None else rows.select(*keep, key(F.col(outer), F.col(inner)).alias("key"), value)


# --- heat maps with sub-columns

def subheatmap_frame(cells: DataFrame, row_cols: Sequence[str], col_cols: Sequence[str], sub_cols: Sequence[str], value_col: str = "value") -> DataFrame:
    """Cells with row_index, col_index (distinct non-sub keys) and sub_index (rank of the sub key), all 1-based.

    Keys must be unique: a cell that occurs twice is an error when computed.
    """
    rows = dense_rank_table(cells.select(*row_cols).distinct(), row_cols, "row_index")
    cols = dense_rank_table(cells.select(*col_cols).distinct(), col_cols, "col_index")
    subs = dense_rank_table(cells.select(*sub_cols).distinct(), sub_cols, "sub_index")
    out = cells.join(rows, list(row_cols)).join(cols, list(col_cols)).join(subs, list(sub_cols))
    n = F.count("*").over(Window.partitionBy("row_index", "col_index", "sub_index"))
    return out.withColumn(value_col, F.when(n > 1, F.raise_error(F.lit("a cell occurs twice")).cast("double")).otherwise(F.col(value_col)))
