"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that a document belongs to),
which leaves a table as small as the number of patterns.  Pattern to source arcs carry words; a pattern's
supply arcs are convex: the first pass over its documents is cheap, each repetition dearer.  Shortest augmenting
paths route each pattern's words to the sources' quotas (``mix_flow``); then every pattern's documents are
taken in an order that a seeded hash of the id gives.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; documents of
size 0 are taken 0 times; no documents give no rows.  Repeated rows of one id share a place in the order and
are all taken or all left, except at the last document taken, where rows follow by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import dense_rank_table
from ..session import materialize
from .mix_flow import flow_on_executors, min_cost_flow
from .rows import few, unboxed, whole

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns that the driver routes.  More patterns than these are planned on the executors.  Sources that overlap are at most so many: the
#: driver holds some numbers for each.
MAX_PATTERNS = 200_000
BINS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def membership(docs: DataFrame, source: str) -> Column:
    """The sorted set of a row's sources; none is the null source."""
    none = F.array(F.lit(None).cast("string"))
    if not dict(docs.dtypes)[source].startswith("array"):
        return F.array(F.col(source))
    return F.array_distinct(F.sort_array(F.when(F.size(F.coalesce(F.col(source), none)) > 0, F.col(source)).otherwise(none)))


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size, and what is above is shared again."""
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > most * sizes[i]} if w else set()
        if not over:
            for i in free:
                target[i] = rest * weights[i] / w if w else 0.0
            break
        for i in over:
            target[i] = most * float(sizes[i])
            rest -= target[i]
        free -= over
        rest = max(rest, 0.0)
    return target


def plan_of_sources(words: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """(pattern, whole, part, source_size, target) of sources that do not overlap, however many: (pattern, words), a pattern being
    one source.

    What the flow gives is then each source's target.  The level to which weights are filled rises until no other source
    is over its limit; a round is one aggregation.
    """
    ranked = dense_rank_table(words.select("pattern", F.get("pattern", F.lit(0)).alias("s"), F.col("words").cast("double").alias("size")), ["s"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ranked.withColumn("w", weight).withColumn("limit", most * F.col("size")), "sources")
    total, free = rows.agg(F.sum("size"), F.sum("w")).first()
    level, before = total_share * total / free, -1.0
    while level != before:
        full = F.col("limit") < F.col("w") * level
        used, free = rows.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        level, before = ((total_share * total - used) / free if free else float("inf")), level
        if not free or level < before:
            break
    target = F.least("limit", F.col("w") * F.lit(level)) if level != float("inf") else F.col("limit")
    rows = rows.withColumn("target", target)
    whole = F.when(F.col("size") > 0, F.least(F.floor((F.col("target") + 1e-6) / F.col("size")), F.lit(int(most)))).otherwise(0).cast("int")
    return rows.withColumn("whole", whole).select("pattern", "whole", (F.col("target") - F.col("whole") * F.col("size")).alias("part"), F.col("size").alias("source_size"), "target")


def plan_of_patterns(words: DataFrame, weights: Sequence[float], total_share: float, most: float, max_sources: int = MAX_PATTERNS) -> DataFrame:
    """(pattern, whole, part, source_size, target) of patterns of overlapping sources, however many: (pattern, words).

    The driver holds sources, executors patterns.
    """
    sizes = words.select(F.explode("pattern").alias("s"), "words").groupBy("s").agg(F.sum("words").alias("words")).limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources that overlap")
    size_of = {r["s"]: float(r["words"]) for r in sizes}
    names = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    total = float(words.agg(F.sum("words")).first()[0])
    target = capped_targets([size_of[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], total_share * total, most)
    spark = words.sparkSession
    at = F.broadcast(spark.createDataFrame([(s, i, size_of[s], target[i]) for i, s in enumerate(names)], "s string, i long, size double, target double"))
    arcs = words.select("pattern", "words", F.explode("pattern").alias("_s")).join(at, F.col("_s").eqNullSafe(F.col("s")))
    named = arcs.groupBy("pattern").agg(F.first("words").cast("double").alias("words"), F.sort_array(F.collect_list("i")).alias("members"), F.sum("size").alias("source_size"), F.sum("target").alias("target"))
    named = materialize(named, "patterns")
    routed = flow_on_executors(named, target, passes=int(most)).select(F.to_json(F.struct("pattern")).alias("tag"), F.aggregate("flow", F.lit(0.0), lambda a, x: a + x).alias("amount"))
    rows = named.withColumn("tag", F.to_json(F.struct("pattern"))).join(routed, "tag").drop("tag")
    whole = F.when(F.col("words") > 0, F.least(F.floor((F.col("amount") + 1e-6) / F.col("words")), F.lit(int(most)))).otherwise(0).cast("int")
    return rows.withColumn("whole", whole).select("pattern", "whole", (F.col("amount") - F.col("whole") * F.col("words")).alias("part"), "source_size", "target")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source: str = "source", max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies, pattern.

    ``source`` may be a string column or an array of strings (overlapping sources).  Sources in code point
    order, null last, weigh ``weights``, repeating; they share ``total_share`` of all words.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), membership(docs, source).alias("pattern"), order.alias("at")), "sizes")
    bins = materialize(sized.withColumn("bin", F.shiftrightunsigned("at", 52)).groupBy("pattern", "bin").agg(F.sum("size").alias("words")), "bins")
    words = bins.groupBy("pattern").agg(F.sum("words").alias("words"))
    found = words.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        if dict(docs.dtypes)[source].startswith("array"):
            return _taken(sized, bins, plan_of_patterns(words, weights, total_share, most), most)
        return _taken(sized, bins, plan_of_sources(words, weights, total_share, most), most)
    supply = {tuple(r["pattern"]): float(r["words"]) for r in found}
    member = {p: sorted(p, key=lambda s: (s is None, (s or "").encode())) for p in supply}
    names = sorted({s for p in member.values() for s in p}, key=lambda s: (s is None, (s or "").encode()))
    size_of = {s: sum(w for p, w in supply.items() if s in member[p]) for s in names}
    target = dict(zip(names, capped_targets([size_of[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], total_share * sum(supply.values()), most), strict=True))
    flow = min_cost_flow(supply, target, member, passes=int(most))
    rows = []
    for p in supply:
        amount = sum(flow.get((p, s), 0.0) for s in member[p])
        whole = min(int((amount + 1e-6) // supply[p]), int(most)) if supply[p] else 0
        rows.append((list(p), whole, amount - whole * supply[p], float(sum(size_of[s] for s in p)), float(sum(target[s] for s in p))))
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(rows, "pattern array<string>, whole int, part double, source_size double, target double"))
    return _taken(sized, bins, plan, most)


def _taken(sized: DataFrame, bins: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Documents by the plan of their pattern: whole passes, and a part in the order of their hash."""
    # null elements: join on a text form, in which null differs from every name
    tag = F.to_json(F.struct("pattern")).alias("tag")
    plan = plan.select("*", tag).drop("pattern")
    sums = bins.select("*", tag).join(plan, "tag")
    upto = Window.partitionBy("tag").orderBy("bin")
    # the bin in which the part ends: all before it are taken once more, all after it are not
    edge = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).where("before < part and before + words >= part")
    edge = materialize(edge.groupBy("tag").agg(F.min(F.struct("bin", "before")).alias("e")).select("tag", F.col("e.bin").alias("edge"), F.col("e.before").alias("before")), "edge")
    marked = sized.select("*", tag).join(plan, "tag").join(few(edge), "tag", "left").withColumn("bin", F.shiftrightunsigned("at", 52))
    inside = Window.partitionBy("tag").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = marked.where("bin = edge").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    # the last document is taken when that brings the sum nearer to the part
    more = F.when(F.col("upto") - F.col("size") / 2 <= F.col("part"), 1).otherwise(0)
    off_edge = marked.where("edge is null or bin <> edge").withColumn("upto", F.lit(None).cast("double"))
    more = F.when(F.col("edge").isNull(), 0).when(F.col("bin") < F.col("edge"), 1).when(F.col("bin") > F.col("edge"), 0).otherwise(more)
    both = off_edge.unionByName(at_edge).withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("whole") + more, F.lit(int(most)))).otherwise(0).cast("int"))
    return both.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "pattern")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as many times as it is taken."""
    id_col = parameters.get("id_col", "doc_id")
    taken = mix(docs, **parameters).groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("pattern").alias("_pattern")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    own = docs.select(whole(docs).alias("doc"), F.col(id_col).alias("id"), n_words(F.col(parameters.get("text_col", "text"))).alias("size"), membership(docs, parameters.get("source", "source")).alias("pattern"))
    joined = own.join(taken, own["id"].eqNullSafe(taken["_id"]) & (own["size"] == taken["_size"]) & own["pattern"].eqNullSafe(taken["_pattern"]))
    return unboxed(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)
