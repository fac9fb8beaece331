"""Rows of any schema, kept apart from an operator's own columns, and batches that hold whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast, some 20 MB; what is larger is joined by a shuffle.
FEW = 200_000


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that none can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unboxed(df: DataFrame, docs: DataFrame, box: str = "doc") -> DataFrame:
    """The columns of ``docs`` again."""
    return df.select(*[F.col(box).getField(c).alias(c) for c in docs.columns])


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): texts are strings, null ids stay null."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def few(written: DataFrame, rows: int = FEW) -> DataFrame:
    """``written``, a table of narrow rows, marked for broadcast if its count is within the bound."""
    return F.broadcast(written) if written.count() <= rows else written


def least_by_hash(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of least hash ``h`` (a long); of a large table only about that many are sorted and sent."""
    place = F.pmod(h, F.lit(1 << 40))
    n = df.count()
    if n > rows:  # one and a half times the rows that are wanted, and 500 more, pass the bound
        df = df.where(place <= int((1.5 * rows + 500) / n * (1 << 40)))
    return df.orderBy(place).limit(rows)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where a value of ``key`` ends; batches come sorted by it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t[key].to_numpy()
            turns = np.flatnonzero(k[1:] != k[:-1])
            if len(turns):
                cut = int(turns[-1]) + 1
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                n = len(t) - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, one: Callable[[pa.RecordBatch], dict], schema: str, types: dict[str, pa.DataType]) -> DataFrame:
    """``mapInArrow`` by a function from a batch to columns; ids pass as Arrow arrays and keep all their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = one(b)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[n]) for n, c in made.items()], names=list(made))

    return df.mapInArrow(run, schema)
