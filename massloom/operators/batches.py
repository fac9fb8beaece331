"""Arrow batches inside of tasks, and tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows``, ``each`` of them in one, and not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], counts: DataFrame | None = None, most: int = 1024, each: int = 1 << 21) -> DataFrame:
    """``left`` joined with ``right`` on keys that many rows of both may have.

    Rows of a key are dealt by hash to blocks of about ``most``, each two of which meet in a cell of their own, and a task has about ``each`` rows of the
    result.  ``counts``: (on, count) of ``left``, if it is known without making it.
    """
    sizes = (left.groupBy(*on).count() if counts is None else counts).select(*on, F.col("count").alias("_n")).join(right.groupBy(*on).agg(F.count("*").alias("_m")), list(on))
    sizes = materialize(sizes, "sizes")
    n = tasks(left.sparkSession, int(sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0), each)
    blocks = lambda c: F.ceil(F.col(c) / most)

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), blocks(own))
        x = df.join(sizes, list(on)).select(*df.columns, block.alias(i), F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)).alias(j))
        return x.repartition(n, *on, "_i", "_j")

    return dealt(left, "_n", "_m", "_i", "_j").join(dealt(right, "_m", "_n", "_j", "_i"), [*on, "_i", "_j"]).drop("_i", "_j")


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where the values of ``keys`` (numbers) change; batches come sorted by them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        changes = np.zeros(len(t) - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            changes |= v[1:] != v[:-1]
        turns = np.flatnonzero(changes)
        if len(turns):
            cut = int(turns[-1]) + 1
            yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), len(t) - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
