"""Statistics: hypergeometric tails, weighted median, quantile grids, Lambert W."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a few numbers each that may be broadcast.
FEW = 200_000


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 10 on (error under 1e-12), by table below."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(10)]), (F.least(F.greatest(n, F.lit(0)), F.lit(9)) + 1).cast("int"))
    return F.when(n < 10, small).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeom_log10_sf(overlap: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """log10 P(X >= overlap), X hypergeometric: ``drawn`` of ``total`` objects, ``marked`` of which count.

    The terms of the tail are summed relative to the first, by their ratio: one pass of as many steps as the tail has.
    """
    k0 = F.greatest(overlap, drawn + marked - total, F.lit(0)).cast("long")
    top = F.least(drawn, marked).cast("long")
    first = _log_choose(marked, k0) + _log_choose(total - marked, drawn - k0) - _log_choose(total, drawn)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * ((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1)).cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.when(top > k0, F.aggregate(F.sequence(k0, top - 1), zero, step, lambda a: a["sum"])).otherwise(F.lit(1.0))
    value = F.least((first + F.log(tail)) / math.log(10), F.lit(0.0))
    return F.when(k0 > top, F.lit(float("-inf"))).when(overlap <= drawn + marked - total, F.lit(0.0)).when(overlap <= 0, F.lit(0.0)).otherwise(value)


def _spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None) -> DataFrame:
    """``df`` by ranges of key (as ``_k``, which may hold nulls) and ``order``, with the number of the range as ``_part``.

    A key with many rows is in many ranges.  It is written once: the bounds come from a sample, and another evaluation could draw others.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    return materialize(keyed.repartitionByRange(n, "_k", *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _few(df: DataFrame) -> DataFrame:
    """A small table, to be broadcast if its count is within the bound."""
    written = materialize(df, "offsets")
    return F.broadcast(written) if written.count() <= FEW else written


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rank: str = "rank", share: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with the ordinal rank of each row within its keys, and ``share``, the rank over the number of the keys' rows.

    Rows are ranked inside ranges of key and order, and the sizes of a key's ranges give the offsets; so a key of any size is spread over
    tasks.  The order should end with a column that tells rows apart: equal rows are in one range.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _spread(df, keys, by, parts)
    w = Window.partitionBy("_k").orderBy("_part")
    sizes = rows.groupBy("_k", "_part").agg(F.count("*").alias("_n"))  # as many rows as keys and ranges
    offsets = _few(sizes.select("_k", "_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_k")).alias("_all")))
    own = F.row_number().over(Window.partitionBy("_part", "_k").orderBy(*by))
    out = rows.withColumn("_own", own).join(offsets, ["_k", "_part"]).withColumn(rank, F.col("_before") + F.col("_own"))
    if share:
        out = out.withColumn(share, F.col(rank) / F.col("_all"))
    return out.drop("_k", "_part", "_own", "_before", "_all")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], parts: int | None = None) -> list[float]:
    """Quantiles of a column, interpolated between the two values at (n - 1) times each share; none without values; NaN and null do not count.

    Values are counted by ranges, and only those ranges are put in order that hold a place which is asked for, so no task has all values.
    """
    v = F.col(value).cast("double")
    rows = _spread(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("_v")).agg(F.count("*").alias("_c")), [], [F.col("_v")], parts)
    sizes = sorted(rows.groupBy("_part").agg(F.sum("_c").alias("n")).collect(), key=lambda r: r["_part"])  # a row for each range
    total = sum(r["n"] for r in sizes)
    if not total:
        return []
    places = {h: (total - 1) * h for h in shares}
    wanted = sorted({p for x in places.values() for p in (math.floor(x), math.ceil(x))})
    upto, holds = 0, []
    for r in sizes:
        own = [p for p in wanted if upto <= p < upto + r["n"]]
        if own:
            holds.append((r["_part"], upto, own))
        upto += r["n"]
    asked = df.sparkSession.createDataFrame(holds, "_part int, _before long, _places array<long>")
    end = F.sum("_c").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    ends = rows.join(F.broadcast(asked), "_part").withColumn("_end", end)
    found = ends.select("_v", "_end", "_c", F.explode("_places").alias("p")).where("p < _end and p >= _end - _c").select("p", "_v").collect()  # two for each share
    at = {r["p"]: r["_v"] for r in found}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places.values()]


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "wmedian", parts: int | None = None) -> DataFrame:
    """Per group the value at half of the weight, interpolated between the midpoints of the weights; equal values by weight.

    Rows of weight 0 or null count for nothing, equal rows are added up first.  Weights are added up by ranges of key and value, and only in
    the one range of a key that holds its half are rows put in order, so a key of any size is spread over tasks.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys, v.alias("_v"), w.alias("_w")).agg(F.count("*").alias("_c"))
    rows = _spread(rows, keys, [F.col("_v"), F.col("_w")], parts)
    by_key = Window.partitionBy("_k").orderBy("_part")
    sums = rows.groupBy("_k", "_part").agg(F.sum(F.col("_w") * F.col("_c")).alias("_s"), F.max(F.struct("_v", "_w")).alias("_last"))
    upto = F.sum("_s").over(by_key)
    sums = sums.select("_k", "_part", (upto - F.col("_s")).alias("_before"), (F.sum("_s").over(Window.partitionBy("_k")) / 2).alias("_half"), (upto - F.col("_last._w") / 2).alias("_end"), F.col("_last._v").alias("_last"))
    sums = sums.withColumns({"_end0": F.lag("_end").over(by_key), "_last0": F.lag("_last").over(by_key)})
    # the first range whose last midpoint reaches the half; with roundings against it, the last
    reach = F.col("_end") >= F.col("_half")
    chosen = _few(sums.groupBy("_k").agg(F.coalesce(F.min_by(F.when(reach, F.struct("_part", "_before", "_half", "_end0", "_last0")), F.when(reach, F.col("_part"))), F.max_by(F.struct("_part", "_before", "_half", "_end0", "_last0"), "_part")).alias("x")).select("_k", "x.*"))
    inside = Window.partitionBy("_k").orderBy("_v", "_w")
    own = F.sum(F.col("_w") * F.col("_c")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    rows = rows.join(chosen, ["_k", "_part"]).withColumn("_upto", own)
    # midpoints of the first and the last of equal rows
    rows = rows.withColumns({"_mid": F.col("_upto") - F.col("_w") * (F.col("_c") - 0.5), "_mid1": F.col("_upto") - F.col("_w") / 2})
    rows = rows.withColumns({"_prev": F.coalesce(F.lag("_mid1").over(inside), "_end0"), "_value0": F.coalesce(F.lag("_v").over(inside), "_last0"), "_at": F.row_number().over(inside)})
    reached = F.col("_mid1") >= F.col("_half")
    pick = F.struct("_v", "_mid", "_prev", "_value0", "_half")
    at = rows.groupBy("_k").agg(F.coalesce(F.min_by(F.when(reached, pick), F.when(reached, F.col("_at"))), F.max_by(pick, "_at")).alias("x"))
    between = F.col("x._value0") + (F.col("x._half") - F.col("x._prev")) / (F.col("x._mid") - F.col("x._prev")) * (F.col("x._v") - F.col("x._value0"))
    inner = F.when(F.col("x._prev").isNull() | (F.col("x._mid") <= F.col("x._half")), F.col("x._v")).otherwise(between)
    return at.select(*[F.col(f"_k.{k}").alias(k) for k in keys], inner.alias(name))


def skyline(df: DataFrame, first: str, second: str, parts: int | None = None) -> DataFrame:
    """Rows that no other is at least as good as in both columns and better in one, large being good; ties stay, rows with nulls or NaN go.

    Of each value of ``first`` the best ``second`` counts; these are put in ranges, and what is best above a range is one number.
    """
    fine = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & ~F.isnan(F.col(first).cast("double")) & ~F.isnan(F.col(second).cast("double")))
    best = fine.groupBy(F.col(first).alias("_a")).agg(F.max(second).alias("_b"))
    rows = _spread(best, [], [F.col("_a")], parts)
    tops = rows.groupBy("_part").agg(F.max("_b").alias("_top"))  # a row for each range
    above = F.broadcast(tops.select("_part", F.max("_top").over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_above")))
    inside = F.max("_b").over(Window.partitionBy("_part").orderBy(F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, -1))
    left = rows.join(above, "_part").withColumn("_over", F.greatest("_above", inside)).where("_over is null or _over < _b").select("_a", "_b")
    return fine.join(left, (F.col(first) == F.col("_a")) & (F.col(second) == F.col("_b"))).drop("_a", "_b")


def weighted_sd(value: Column, weight: Column) -> Column:
    """Aggregate: uncorrected weighted standard deviation."""
    mean = F.sum(value * weight) / F.sum(weight)
    return F.sqrt(F.greatest(F.sum(value * value * weight) / F.sum(weight) - mean * mean, F.lit(0.0)))


def quantile_grid(df: DataFrame, value: str, base: float = 2.0, quantile_range: float = 0.99, bins: int = 20) -> list[float]:
    """Q2: log-spaced grid between the floor and ceiling of the log quantiles; ``bins`` numbers."""
    q = df.where(F.col(value) > 0).agg(F.percentile(value, F.array(F.lit((1 - quantile_range) / 2), F.lit((1 + quantile_range) / 2)))).first()[0]
    if q is None:
        return []
    lo, hi = math.floor(math.log(q[0], base)), math.ceil(math.log(q[1], base))
    return [base ** (lo + k * (hi - lo) / (bins - 1)) for k in range(bins)]


def grid_bin(value: Column, grid: Sequence[float]) -> Column:
    """1-based place of the first grid number that is not below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g < value)) + 1


def lambert_w_minus(x: float) -> float:
    """The lower branch of Lambert's W on [-1/e, 0), by Newton's method on w e^w = x in logarithms."""
    if not -1 / math.e <= x < 0:
        raise ValueError("outside of [-1/e, 0)")
    w = math.log(-x) - math.log(-math.log(-x)) if x > -0.25 else -1 - math.sqrt(2 * (1 + math.e * x))
    for _ in range(100):
        step = (w - math.log(x / w)) / (1 + 1 / w) if w < -1 else 0.0
        w -= step
        if abs(step) < 1e-14 * abs(w):
            break
    return w
