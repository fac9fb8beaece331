"""Dense surrogate ids without one-partition windows over facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import extract_or_null
from ..session import materialize

def dense_rank_table(values: DataFrame, order: Sequence[str], name: str = "ix", start: int = 1, parts: int = 256) -> DataFrame:
    """``values`` (distinct rows) with a dense id in ascending order of ``order``, nulls last.

    Values are ranked inside range partitions, whose sizes (one row each) give the offsets, so no task
    holds all values.  The partitions are written once: their bounds come from a sample, and another
    evaluation could draw others.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    n = max(1, min(parts, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = materialize(values.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # at most ``parts`` rows
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return spread.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + rank - 1 + start).cast("long")).drop("_part", "_offset")


def index_unique(df: DataFrame, cols: str | Sequence[str], name: str = "ix", start: int = 1, order_col: str | None = None) -> DataFrame:
    """``df`` with a dense id of the values of ``cols``.

    Sorted by value, nulls last, or, with ``order_col``, by first appearance in that order.  Null is a
    value with an id of its own.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    if order_col is None:
        table = dense_rank_table(df.select(*cols).distinct(), cols, name, start)
    else:
        seen = df.groupBy(*cols).agg(F.min(order_col).alias("_first"))
        table = dense_rank_table(seen, ["_first", *cols], name, start).drop("_first")
    return _with_ids(df, table, cols, [name])


def _with_ids(df: DataFrame, table: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with ``names`` of the row of ``table`` that has its values of ``cols``, null being a value."""
    right = table.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(cols)], *names)
    met = None
    for k, c in enumerate(cols):
        same = df[c].eqNullSafe(right[f"_key{k}"])
        met = same if met is None else met & same
    # each row has a partner; as an outer join it goes where no id is asked for and rows are made distinct
    return df.join(right, met, "left").drop(*[f"_key{k}" for k in range(len(cols))])


def update_protgroups(df: DataFrame) -> DataFrame:
    """protgroup_id from protgroup_sn_id; the alternative accession column where it is the only one."""
    df = index_unique(df, "protgroup_sn_id", "protgroup_id")
    if "majority_protein_acs" not in df.columns and "majority_protein_acs_alt" in df.columns:
        df = df.withColumnRenamed("majority_protein_acs_alt", "majority_protein_acs")
    return df


def update_peptides(df: DataFrame) -> DataFrame:
    """peptide_seq without modifications where it is absent, and its id."""
    if "peptide_seq" not in df.columns:
        df = df.withColumn("peptide_seq", F.regexp_replace("pepmod_seq", r"\[[^\[]+\]", ""))
    return index_unique(df, "peptide_seq", "peptide_id")


def update_pepmodstates_by_order(df: DataFrame, order_col: str) -> DataFrame:
    """Pepmod and pepmodstate ids by first appearance, from 0; charge from the sequence's end."""
    df = index_unique(df, "pepmod_seq", "pepmod_id", 0, order_col)
    df = index_unique(df, "pepmodstate_seq", "pepmodstate_id", 0, order_col)
    return df.withColumn("charge", extract_or_null(F.col("pepmodstate_seq"), r"\.(\d+)$").cast("int"))


def update_pepmodstates(df: DataFrame) -> DataFrame:
    """pepmod_id by (peptide_id, pepmod_seq), pepmodstate_id by (pepmod_id[, msfraction], charge), from 0.

    The fraction counts where any row has one.
    """
    fractions = ["msfraction"] if "msfraction" in df.columns and not df.where("msfraction is not null").isEmpty() else []
    keys = ["peptide_id", "pepmod_seq", *fractions, "charge"]
    # states get their ids among themselves, in one order that is that of both, and rows meet them once
    lead = [F.col(c).asc_nulls_last() for c in ("peptide_id", "pepmod_seq")]
    order = [*lead, *[F.col(c).asc_nulls_last() for c in (*fractions, "charge")]]
    n = max(1, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = materialize(df.select(*keys).distinct().repartitionByRange(n, *lead).withColumn("_part", F.spark_partition_id()), "states")
    part = Window.partitionBy("_part")
    ranked = materialize(spread.withColumn("_state", F.row_number().over(part.orderBy(*order))).withColumn("_mod", F.dense_rank().over(part.orderBy(*lead))), "states")
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"), F.max("_mod").alias("_m"))  # ``n`` rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_m")])
    ids = [(F.col(a) + F.col(b) - 1).cast("long").alias(c) for a, b, c in (("_m", "_mod", "pepmod_id"), ("_n", "_state", "pepmodstate_id"))]
    return _with_ids(df, ranked.join(F.broadcast(offsets), "_part").select(*keys, *ids), keys, ["pepmod_id", "pepmodstate_id"])
