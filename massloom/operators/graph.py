"""Graph operators on (src, dst) frames: components, closure, degrees, one walk step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package

#: Edges that one task settles by itself, some 100 MB of its memory; the result is the same on either side.
ONE_TASK = 1 << 20


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for n vertices and links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_one_task(e: DataFrame) -> DataFrame:
    kind = e.schema["u"].dataType.simpleString()
    ship_package(e.sparkSession)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            names, ends = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
            label = least_labels(len(names), ends[: len(t)], ends[len(t) :])
            for at in range(0, len(names), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(names[own], t["u"].type), pa.array(names[label[own]], t["u"].type)], names=["id", "component"])

    return materialize(e.repartition(1).mapInArrow(settle, f"id {kind}, component {kind}"), "components")


def _contracted(e: DataFrame, one_task: int) -> DataFrame:
    """(id, component) of the ends of edges (u, v) between different long numbers.

    In a step every vertex goes to its least neighbour or itself, and edges go with it, so a component stays one and gets smaller; in every
    other step a vertex of one neighbour goes to that one.  From the third step on what is least is drawn by hash, anew in each, so
    no order of numbers makes many steps: their vertices are then called by the hashes, which differ for different numbers.
    """
    steps: list[DataFrame] = []
    held: list[DataFrame] = []  # (name, least): vertices after each step, with the least number that went there
    while e.count() > one_task:
        k = len(steps)
        name = (lambda c, k=k: F.xxhash64(F.lit(k), c)) if k > 1 else F.col
        least = e.union(e.select("v", "u")).groupBy("u").agg(F.min(name("v")).alias("m"), F.max(name("v")).alias("top"))
        down = F.least("m", name("u"))
        to = materialize(least.select("u", (F.when(F.col("m") == F.col("top"), F.col("m")).otherwise(down) if k % 2 == 0 else down).alias("to")), "steps")
        went = to.select("to", F.col("u").alias("least")) if not held else to.join(held[-1], to["u"] == held[-1]["name"]).select("to", "least")
        held.append(materialize(went.groupBy(F.col("to").alias("name")).agg(F.min("least").alias("least")), "vertices"))
        steps.append(to)
        e = e.join(to, "u").select("v", F.col("to").alias("a")).join(to.withColumnRenamed("u", "v"), "v").where("a <> to").select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v"))
        e = materialize(e.distinct(), "edges")
    if not steps:
        return _in_one_task(e)
    met = held[-1].join(_in_one_task(e).withColumnRenamed("id", "name"), "name")
    label = met.join(met.groupBy("component").agg(F.min("least").alias("label")), "component").select("name", "label")
    for k in range(len(steps) - 1, -1, -1):  # back to the numbers; who has no edge left has a component of its own
        label = materialize(held[k].join(label, "name", "left").select("name", F.coalesce("label", "least").alias("label")), "labels")
        label = steps[k].join(label, steps[k]["to"] == label["name"]).select(F.col("u").alias("name"), "label")
    return label.select(F.col("name").alias("id"), F.col("label").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id that each vertex reaches, for every vertex of an edge.

    Up to ``one_task`` edges between numbers or strings are settled by one task.  Graphs of more edges between numbers are contracted until
    they are so small (``_contracted``); edges between others go by alternating large-star and small-star steps:
    each round maps every vertex's neighbours to the smallest of them, so the number of rounds grows with the
    logarithm of the component size.  Each step is one aggregation with map-side combine and joins, which AQE
    splits when a hub is hot.  Rounds are cut by tables in the shared folder.  Null ends and self loops of ``edges``
    add nothing but, for loops, the vertex itself.
    """
    e = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"), "edges")
    if not isinstance(e.schema["u"].dataType, (T.StructType, T.ArrayType, T.MapType)) and e.count() <= one_task:
        return _in_one_task(e)
    if all(isinstance(e.schema[c].dataType, T.IntegralType) for c in ("u", "v")):
        kind = e.schema["u"].dataType
        e = e.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        found = _contracted(e.where("u <> v"), one_task)
        loops = e.where("u = v").select(F.col("u").alias("id")).distinct()
        if not loops.isEmpty():
            found = materialize(found, "components")
            found = found.union(loops.join(found, "id", "left_anti").select("id", "id"))
        return found.select(*[F.col(c).cast(kind).alias(c) for c in ("id", "component")])
    vertices = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    star = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = materialize(star, "edges")
    seen = None
    for _ in range(max_rounds):
        both = star.union(star.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        star = materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(star.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))
