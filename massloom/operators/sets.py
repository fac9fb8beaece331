"""Set collections as long frames, and enrichment filters over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hypergeom_log10_sf


def frame_to_sets(df: DataFrame, set_col: str, obj_col: str, min_size: int = 1, coll_col: str | None = None) -> DataFrame:
    """(set[, coll], objs sorted) of sets with at least ``min_size`` rows and distinct non-null objects.

    Null is a set of its own; null objects count as rows alone.
    """
    keys = ([coll_col] if coll_col else []) + [set_col]
    sets = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(obj_col)).alias("objs"))
    return sets.where((F.col("_n") >= min_size) & (F.size("objs") >= min_size)).drop("_n")


def set_members(df: DataFrame, set_col: str, obj_col: str, min_size: int = 1, coll_col: str | None = None) -> DataFrame:
    """The same as a long frame, without gathering a set in one row."""
    keys = ([coll_col] if coll_col else []) + [set_col]
    rows = df.groupBy(*keys, obj_col).agg(F.count("*").alias("_rows"))
    sizes = rows.groupBy(*keys).agg(F.sum("_rows").alias("_n"), F.count(obj_col).alias("_d")).where((F.col("_n") >= min_size) & (F.col("_d") >= min_size))
    met = None
    right = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys])
    for k in keys:
        same = rows[k].eqNullSafe(right[f"_{k}"])
        met = same if met is None else met & same
    return rows.where(F.col(obj_col).isNotNull()).join(right, met, "left_semi").select(*keys, obj_col)


#: What ``signatures`` tells of a set: equal for equal sets, and for others but by chance of hashes of 128 bits.
SIGNATURE = ("_n", "_h1", "_h2", "_h3")


def signatures(rows: DataFrame, keys: Sequence[str], parts: Sequence[str], *more: Column, there: Column | None = None) -> DataFrame:
    """(keys, SIGNATURE[, more]) of the set of ``parts``, distinct rows (with ``there``, those where it holds), that each key has, by sums of
    hashes: none is gathered, and a hot key is summed where its rows are.  Null is a value."""
    told = [x for p in parts for x in (F.col(p).isNull(), F.col(p))]
    h, other = F.xxhash64(*told), F.xxhash64(F.lit(1), *told)
    if there is not None:
        h, other = F.when(there, h), F.when(there, other)
    sums = [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32)), F.bit_xor(other)]
    return rows.groupBy(*keys).agg(F.count(h).alias("_n"), *[F.coalesce(x, F.lit(0).cast("long")).alias(c) for x, c in zip(sums, SIGNATURE[1:], strict=True)], *more)


def sets_to_frame(sets: DataFrame, set_col: str, obj_col: str = "obj", set2coll: DataFrame | None = None, coll_col: str = "coll_id") -> DataFrame:
    """One row per member; with ``set2coll`` (set_col, coll_col) the collection too, null where unknown."""
    rows = sets.select(*[c for c in sets.columns if c != "objs"], F.explode("objs").alias(obj_col))
    return rows if set2coll is None else rows.join(set2coll.select(set_col, coll_col), set_col, "left")


def group_by_source(info: DataFrame, members: DataFrame, set_col: str = "term_id", src_col: str = "src") -> DataFrame:
    """Members with their set's source as the collection."""
    return members.join(info.select(set_col, F.col(src_col).alias("coll_id")).distinct(), set_col)


def set_counts(members: DataFrame, observed: DataFrame, reference: DataFrame, set_col: str, obj_col: str, coll_col: str | None = None) -> DataFrame:
    """O1, O2: per set n_both (in reference and observed), n_ref, n_obs, and the totals of all objects, with relevance.

    ``observed`` and ``reference`` hold distinct ``obj_col``.  Relevance is minus the log10 of the hypergeometric upper
    tail of drawing n_both reference objects among the set's n_obs observed ones.
    """
    keys = ([coll_col] if coll_col else []) + [set_col]
    marks = members.select(*keys, obj_col).distinct()
    marks = marks.join(observed.select(obj_col, F.lit(True).alias("_obs")).distinct(), obj_col, "left").join(reference.select(obj_col, F.lit(True).alias("_ref")).distinct(), obj_col, "left")
    counts = marks.groupBy(*keys).agg(F.count_if(F.col("_obs") & F.col("_ref")).alias("n_both"), F.count_if("_ref").alias("n_ref"), F.count_if("_obs").alias("n_obs"), F.count("*").alias("n_set"))
    n_all = F.broadcast(observed.select(obj_col).union(reference.select(obj_col)).distinct().agg(F.count("*").alias("n_all")))
    n_hit = F.broadcast(reference.select(obj_col).distinct().agg(F.count("*").alias("n_hit")))
    return counts.crossJoin(n_all).crossJoin(n_hit)  # one row each


def with_pvalue(counts: DataFrame, overlap: str, drawn: str, marked: str, total: str, name: str = "log10_pvalue") -> DataFrame:
    """Adds log10 of the hypergeometric upper tail P(X >= overlap)."""
    return counts.withColumn(name, hypergeom_log10_sf(F.col(overlap), F.col(drawn), F.col(marked), F.col(total)))


def tighten(scores: DataFrame, set_col: str, score_col: str, max_best: float, max_score: float, max_sets: int = 2500, step: float = 0.5) -> tuple[DataFrame, float, float]:
    """(kept rows, both thresholds): thresholds fall by ``step`` until at most ``max_sets`` sets are left.

    A set is in when its least score is within ``max_best``; its rows are kept within ``max_score``.  The number of steps is
    read off a histogram of the sets' least scores (as many rows as there are steps), not found by recounting.
    """
    best = scores.groupBy(set_col).agg(F.min(score_col).alias("_best")).where(F.col("_best") <= max_best)
    count = {int(r["k"]): r["n"] for r in best.select(F.floor((F.lit(max_best) - F.col("_best")) / step).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    k = 0
    while sum(n for at, n in count.items() if at >= k) > max_sets:
        k += 1
    low, high = max_best - k * step, max_score - k * step
    kept = best.where(F.col("_best") <= low).select(set_col)
    return scores.where(F.col(score_col) <= high).join(kept, set_col, "left_semi").select(*scores.columns), low, high


def automask(overlaps: DataFrame, set_col: str, log10_p_col: str, nmasked_col: str, setsize_col: str | None = None, max_sets: int = 2500, min_nmasked: int = 2, max_setsize: int | None = None, max_min_pvalue: float = 0.01, max_pvalue: float | None = None) -> tuple[DataFrame, float, float]:
    """O3: sets that overlap masks, thresholds of log10 p tightened to ``max_sets``."""
    rows = overlaps.where(F.col(nmasked_col) >= min_nmasked)
    if setsize_col and max_setsize is not None:
        rows = rows.where(F.col(setsize_col) <= max_setsize)
    return tighten(rows, set_col, log10_p_col, math.log10(max_min_pvalue), math.log10(min(max_min_pvalue * 10, 1.0) if max_pvalue is None else max_pvalue), max_sets)


def autoweight(weights: DataFrame, set_col: str, weight_col: str, setsize_col: str | None = None, max_sets: int = 2500, max_setsize: int | None = None, max_min_weight: float = 0.01, max_weight: float | None = None) -> tuple[DataFrame, float, float]:
    """The same for weights; both thresholds fall."""
    rows = weights if setsize_col is None or max_setsize is None else weights.where(F.col(setsize_col) <= max_setsize)
    return tighten(rows, set_col, weight_col, max_min_weight, max_min_weight + 1 if max_weight is None else max_weight, max_sets)


def filter_multicover(
    df: DataFrame, term_cols: Sequence[str], set_cols: Sequence[str], score_col: str, overlap_col: str | None = None, max_term_pvalue: float | None = 1e-4, max_set_pvalue: float | None = None,
    max_entry_pvalue: float | None = None, min_term_overlap: int = 2, min_set_overlap: int | None = None, min_entry_overlap: int = 0,
) -> DataFrame:
    """Significant terms, then the sets significant for one of those, then the entries of both.

    ``score_col`` holds log10 p; null counts as 0, which passes only p = 1.  Thresholds of sets follow those of terms by
    default, entries have none; a step's thresholds hold for the steps before it too.
    """
    p_term = 1.0 if max_term_pvalue is None else max_term_pvalue
    p_set = p_term if max_set_pvalue is None else max_set_pvalue
    p_entry = 1.0 if max_entry_pvalue is None else max_entry_pvalue
    n_set = min_term_overlap if min_set_overlap is None else min_set_overlap
    score = F.coalesce(F.col(score_col), F.lit(0.0))

    def within(p: float, n: int) -> Column:
        met = score <= math.log10(p)
        return met if overlap_col is None else met & (F.col(overlap_col) >= n)

    terms = df.where(within(min(p_term, p_set, p_entry), max(min_term_overlap, n_set, min_entry_overlap))).select(*term_cols).distinct()
    of_terms = df.join(terms, list(term_cols), "left_semi")
    sets = of_terms.where(within(min(p_set, p_entry), max(n_set, min_entry_overlap))).select(*set_cols).distinct()
    return of_terms.join(sets, list(set_cols), "left_semi").where(within(p_entry, min_entry_overlap)).select(*df.columns)
