"""Declarative column groups of wide reports."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import zero_to_null

Fixer = Callable[[Column, str], Column]


@dataclass(frozen=True)
class ColumnGroup:
    """B1: columns by pattern and new name; ``fix`` maps a column and its new name to its clean value."""

    name: str
    rules: tuple[tuple[str, str], ...]
    required: bool = False
    fix: Fixer | None = None
    flags: tuple[str, ...] = ()

    def names(self, columns: Sequence[str]) -> list[tuple[str, str]]:
        """B2: (old, new), rule by rule; a column takes its first rule."""
        out, taken = [], set()
        for pattern, to in self.rules:
            for c in columns:
                if c not in taken and (m := re.search(pattern, c)):
                    taken.add(c)
                    # an optional group that did not take part reads as nothing
                    out.append((c, c[: m.start()] + re.sub(r"\\(\d)", lambda g, m=m: m[int(g[1])] or "", to) + c[m.end() :]))
        return out

    def columns(self, df: DataFrame, skip: set[str] = frozenset()) -> tuple[list[Column], dict[str, str]]:
        """The group's renamed and fixed columns, and old to new names."""
        renamed = {old: new for old, new in self.names(df.columns) if new not in skip}
        cols = []
        for old, new in renamed.items():
            c = F.col(f"`{old}`")
            cols.append((self.fix(c, new) if self.fix else c).alias(new))
        return cols, renamed


#: Columns of the protein-group report whose names hold regex characters that stand for themselves.
LITERAL = ("Mol. weight [kDa]", "Sequence coverage [%]", "Unique + razor sequence coverage [%]", "Unique sequence coverage [%]", "Razor + unique peptides")


def exact(*pairs: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    """Keys to whole-name patterns; the known literal ones are escaped, others may hold regex syntax."""
    return tuple((f"^{re.escape(k) if k in LITERAL else k}$", v) for k, v in pairs)


SCOPE = r"(PG|PEP|EG|R)"


def scoped(*pairs: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    """Keys that start with ``\\.`` are per-run metrics, others plain; without a scope both take the one they find.

    ``[1] a.raw.PG.Quantity`` becomes ``PG_intensity.[1] a.raw``.
    """
    out = []
    for key, new in pairs:
        own = re.match(r"^(?:\\\.)?(?:PG|PEP|EG|R)(?:\\?\.)", key) is not None
        if key.startswith(r"\."):
            out.append((rf"^(.+){key}$", rf"{new}.\1") if own else (rf"^(.+)\.{SCOPE}{key}$", rf"\2_{new}.\1"))
        else:
            out.append((rf"^{re.escape(key)}$", new) if own else (rf"^{SCOPE}\.{key}$", rf"\1_{new}"))
    return tuple(out)


def fix_positive(c: Column, name: str) -> Column:
    """B9 by name."""
    return zero_to_null(c)


def fix_ratio(c: Column, name: str) -> Column:
    """Numbers positive or null; types stay strings."""
    return c if "type" in name else zero_to_null(c)


def fix_ident_type(c: Column, name: str) -> Column:
    """B11."""
    return F.when(c != "", c)


#: Rows of run metadata that are broadcast.
FEW = 200_000
IDENT_TYPES = ("By matching", "By MS/MS")


def _parsed(names: Sequence[str], pattern: str, fields: Sequence[str], numbers: Sequence[str] = ()) -> list[dict]:
    rows = []
    for n in names:
        m = re.match(pattern, n)
        if not m:
            raise ValueError(f"column name {n!r} cannot be parsed")
        row = {"colname": n} | {f: (m[k] or None) for k, f in enumerate(fields, 1)}
        rows.append(row | {f: int(row[f]) for f in numbers if row[f] is not None})
    return rows


# Patterns of report columns, with the fields that their groups are.
MSRUN = (r"^([^.|]+)(?:\.([^|]*))?(?:\|(.+))?$", ("measure", "msrun", "mstag"))
RATIO = (r"^Ratio\.([^ ]+)/([^ ]+)(?:\s([Nn]ormalized|[Vv]ariability \[%\]|[Cc]ount|iso-count|type))?(?:\s(.+))?$", ("nom", "denom", "measure", "sample"))
METRICS = (r"^(?:(PG|PEP|EG|R)_)?([^.]+)\.\[(\d+)\]\s(.+)?$", ("scope", "measure", "rawfile_ix", "rawfile"))


def parse_msrun_columns(names: Sequence[str]) -> list[dict]:
    """measure[.msrun][|mstag]; an empty run is none."""
    return _parsed(names, *MSRUN)


def parse_ratio_columns(names: Sequence[str]) -> list[dict]:
    """B13."""
    return _parsed(names, *RATIO)


def parse_metrics_columns(names: Sequence[str]) -> list[dict]:
    """B14."""
    return _parsed(names, *METRICS, ("rawfile_ix",))


def parsed_names(df: DataFrame, kind: tuple[str, tuple[str, ...]], col: str = "colname", numbers: Sequence[str] = ("rawfile_ix",)) -> DataFrame:
    """B12-B14 for names that are rows, as of a melted report: ``df`` with the fields of ``kind`` (MSRUN, RATIO, METRICS).

    Null names have null fields; a name that does not fit is an error when computed.
    """
    pattern, fields = kind
    fits = F.when(F.col(col).isNull() | F.col(col).rlike(pattern), F.col(col)).otherwise(F.raise_error(F.concat(F.lit("column name cannot be parsed: "), F.col(col))).cast("string"))
    own = {f: F.nullif(F.regexp_extract(fits, pattern, k), F.lit("")) for k, f in enumerate(fields, 1)}
    return df.withColumns({f: c.cast("int") if f in numbers else c for f, c in own.items()})


def column_frame(spark, rows: list[dict]) -> DataFrame:
    fields = list(rows[0]) if rows else ["colname"]
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], ", ".join(f"{f} {'int' if f == 'rawfile_ix' else 'string'}" for f in fields))


def add_run_metadata(df: DataFrame, msruns: DataFrame, group: Sequence[str] = (), suffix: str = "_orig", key: str = "rawfile") -> DataFrame:
    """Run metadata by raw file.

    A key that occurs twice is an error.  A clash with a column of ``group`` renames the old one, others are skipped.
    Runs without metadata keep nulls.  Metadata of up to ``FEW`` runs goes to every task: rows of a report have few run keys,
    and a shuffle by these would bring all rows of a run to one task.
    """
    for side, frame in (("report", df), ("run metadata", msruns)):
        if key not in frame.columns:
            raise ValueError(f"no {key} in the {side}")
    twice = [r[key] for r in msruns.groupBy(key).count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"{key} is not unique in the run metadata: {twice}")
    new = []
    for c in msruns.columns:
        if c == key:
            continue
        if c in df.columns and c in group:
            df = df.withColumnRenamed(c, f"{c}{suffix}")
        elif c in df.columns:
            warnings.warn(f"column {c} is there already, skipped", stacklevel=2)
            continue
        new.append(c)
    runs = msruns.select(key, *new)
    return df.join(F.broadcast(runs) if runs.count() <= FEW else runs, key, "left")
