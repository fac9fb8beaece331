"""Min-cost flow from membership patterns to source quotas, with convex costs of repetition.

A pattern gives its words once for each pass, and the k-th pass costs k.  The cost depends on the pass alone and an augmenting path
never takes words back from a pattern's supply, so a flow of least cost is made pass by pass: each pass is a maximum flow that starts
from the one before.

``min_cost_flow`` routes patterns that fit the driver by phases of blocking flows: distances of sources to the nearest one with quota left,
then paths along falling distances, no arc being looked at twice.  ``flow_on_executors`` is for any number of patterns: these stay
in a table, the driver holds numbers by source alone.  A round finds, for each source, the next one on a shortest way to a quota (words move from
source s to t through the patterns that belong to both), adds up what patterns would send, and moves as much as the tree of these
ways lets through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

EPS = 1e-6


def min_cost_flow(supply: dict, quota: dict, member: dict, passes: int = 2) -> dict:
    """{(pattern, source): words}: as much of ``quota`` as can be routed, at the least cost of repetition.

    ``supply``: words by pattern; ``member``: sources by pattern; a pattern gives its words at most ``passes`` times.
    """
    names = list(quota)
    at = {s: i for i, s in enumerate(names)}
    order = sorted(supply, key=lambda p: (len(member[p]), str(p)))
    to = [at[s] for p in order for s in member[p]]
    ends = np.cumsum([len(member[p]) for p in order]).tolist()
    starts = [0, *ends[:-1]]
    pattern = [i for i, p in enumerate(order) for _ in member[p]]
    into: list[list[int]] = [[] for _ in names]
    for a, s in enumerate(to):
        into[s].append(a)
    flow, given, left = [0.0] * len(to), [0.0] * len(order), [float(quota[s]) for s in names]

    def distances() -> tuple[list[int], list[int]]:
        """Of sources and patterns to the nearest source with quota left; -1: no way."""
        ds, dp = [0 if x > EPS else -1 for x in left], [-1] * len(order)
        queue = deque(s for s, d in enumerate(ds) if d == 0)
        while queue:
            s = queue.popleft()
            for a in into[s]:
                p = pattern[a]
                if dp[p] < 0:
                    dp[p] = ds[s]
                    for b in range(starts[p], ends[p]):
                        if flow[b] > EPS and ds[to[b]] < 0:
                            ds[to[b]] = ds[s] + 1
                            queue.append(to[b])
        return ds, dp

    for k in range(1, passes + 1):
        room = [k * supply[p] - g for p, g in zip(order, given, strict=True)]
        while True:
            ds, dp = distances()
            open_ = [p for p, d in enumerate(dp) if d >= 0 and room[p] > EPS]
            if not open_:
                break
            next_arc, next_in = list(starts), [0] * len(names)
            for first in open_:
                while room[first] > EPS:
                    # arcs taken in turn: forward from a pattern to a source, back from a source to a pattern
                    path: list[int] = []
                    p = first
                    while True:
                        while next_arc[p] < ends[p] and ds[to[next_arc[p]]] != dp[p]:
                            next_arc[p] += 1
                        if next_arc[p] == ends[p]:  # no way from here: the arc that led here is done with
                            if not path:
                                break
                            next_in[to[path.pop()]] += 1
                            p = pattern[path.pop()]
                            continue
                        a = next_arc[p]
                        s = to[a]
                        if left[s] > EPS:
                            path.append(a)
                            break
                        back = into[s]
                        while next_in[s] < len(back) and not (ds[s] > 0 and flow[back[next_in[s]]] > EPS and dp[pattern[back[next_in[s]]]] == ds[s] - 1):
                            next_in[s] += 1
                        if next_in[s] == len(back):
                            next_arc[p] += 1
                            continue
                        path += [a, back[next_in[s]]]
                        p = pattern[path[-1]]
                    if not path:
                        break
                    amount = min([room[first], left[to[path[-1]]], *[flow[a] for a in path[1::2]]])
                    for i, a in enumerate(path):
                        flow[a] += -amount if i % 2 else amount
                    room[first] -= amount
                    given[first] += amount
                    left[to[path[-1]]] -= amount
    return {(order[pattern[a]], names[to[a]]): x for a, x in enumerate(flow) if x > EPS}


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern's place in the batch, source, flow) of every arc, and where each pattern's arcs begin."""
    members = b.column("members")
    n = np.diff(members.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), members.flatten().to_numpy(), b.column("flow").flatten().to_numpy(), np.cumsum(n) - n


def _tree(b: pa.RecordBatch, room: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern with room the arc to its nearest source; and which patterns have one."""
    row, source, _, first = _flat(b)
    far = np.where(dist[source] < 0, np.iinfo(np.int64).max, dist[source])
    arcs = np.lexsort((source, far, row))[first] if len(first) else first
    return arcs, (room > EPS) & (dist[source[arcs]] >= 0)


def _sums(run: Callable[[pa.RecordBatch], dict], rows: DataFrame, schema: str) -> DataFrame:
    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = run(b)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return rows.mapInArrow(all_batches, schema)


def _pairs(rows: DataFrame) -> DataFrame:
    """(s, t, words): what could move from source s to source t."""
    arcs = F.transform(F.arrays_zip("members", "flow"), lambda x: F.struct(x["members"].alias("s"), x["flow"].alias("f")))
    held = rows.select("members", F.explode(F.filter(arcs, lambda x: x["f"] > EPS)).alias("a"))
    return held.select(F.col("a.s").alias("s"), F.explode("members").alias("t"), F.col("a.f").alias("f")).where("s <> t").groupBy("s", "t").agg(F.sum("f").alias("words"))


def flow_on_executors(patterns: DataFrame, quota: Sequence[float], passes: int = 2) -> DataFrame:
    """(pattern, members, words, flow): ``patterns`` (pattern, members array<long>: places in ``quota``, words double) with the words that go
    to each member, as ``min_cost_flow`` has them in all; the driver holds a few numbers for each source."""
    ship_package(patterns.sparkSession)
    n = len(quota)
    left = np.array(quota, float)
    rows = materialize(patterns.select("pattern", "members", "words", F.transform("members", lambda _: F.lit(0.0)).alias("flow")), "flow")
    spark = rows.sparkSession
    for k in range(1, passes + 1):
        while True:
            dist, after, width = np.where(left > EPS, 0, -1), np.full(n, -1), np.zeros(n)
            pairs = materialize(_pairs(rows), "pairs")
            level = np.flatnonzero(dist == 0)
            while len(level):
                ends = F.broadcast(spark.createDataFrame(level[:, None].tolist(), "t long"))  # sources of one distance
                best = pairs.where(F.col("words") > EPS).join(ends, "t").groupBy("s").agg(F.max(F.struct("words", "t")).alias("b")).select("s", "b.*").toPandas()
                best = best[dist[best["s"].to_numpy(np.int64)] < 0]
                s = best["s"].to_numpy(np.int64)
                dist[s], after[s], width[s] = (dist[level[0]] + 1), best["t"], best["words"]
                level = s

            def wanted(b: pa.RecordBatch, dist: np.ndarray = dist, k: int = k) -> dict:
                row, source, flow, first = _flat(b)
                room = k * b.column("words").to_numpy() - np.bincount(row, flow, b.num_rows)
                arcs, free = _tree(b, room, dist)
                sums = np.bincount(source[arcs[free]], room[free], len(dist))
                at = np.flatnonzero(sums)
                return {"s": at.astype(np.int64), "room": sums[at]}

            asked = np.zeros(n)
            found = _sums(wanted, rows, "s long, room double").groupBy("s").agg(F.sum("room").alias("room")).toPandas()
            asked[found["s"].to_numpy(np.int64)] = found["room"]
            if asked.sum() <= EPS:
                break
            # what comes to a source from patterns and from sources behind it, then what is let through, nearest first
            up = np.argsort(-dist, kind="stable")
            demand = asked.copy()
            for s in up:
                if dist[s] > 0:
                    demand[after[s]] += min(width[s], demand[s])
            through = np.zeros(n)
            for s in up[::-1]:
                if dist[s] == 0:
                    through[s] = min(left[s], demand[s])
                elif dist[s] > 0 and demand[after[s]] > 0:
                    through[s] = min(width[s], demand[s]) * (through[after[s]] / demand[after[s]])
            taken = np.divide(through, demand, out=np.zeros(n), where=demand > 0)  # of what patterns ask of a source
            moved = np.divide(through, width, out=np.zeros(n), where=(width > 0) & (dist > 0))  # of what may move on
            ends = dist == 0
            left[ends] -= through[ends]

            def move(b: pa.RecordBatch, dist: np.ndarray = dist, after: np.ndarray = after, taken: np.ndarray = taken, moved: np.ndarray = moved, k: int = k) -> dict:
                row, source, flow, first = _flat(b)
                room = k * b.column("words").to_numpy() - np.bincount(row, flow, b.num_rows)
                arcs, free = _tree(b, room, dist)
                new = flow.copy()
                new[arcs[free]] += room[free] * taken[source[arcs[free]]]
                # an arc to s gives to the arc to the source after s, where the pattern has one
                key = row * (len(dist) + 1) + source
                order = np.argsort(key)
                goal = row * (len(dist) + 1) + np.where(after[source] >= 0, after[source], len(dist))
                hit = np.minimum(np.searchsorted(key, goal, sorter=order), len(key) - 1)
                gives = np.flatnonzero((key[order[hit]] == goal) & (flow > EPS)) if len(key) else hit
                amount = flow[gives] * moved[source[gives]]
                np.add.at(new, order[hit[gives]], amount)
                new[gives] -= amount
                offsets = pa.array(np.append(first, len(source)).astype(np.int32))
                return {"pattern": b.column("pattern"), "members": b.column("members"), "words": b.column("words"), "flow": pa.ListArray.from_arrays(offsets, pa.array(new))}

            rows = materialize(_sums(move, rows, "pattern array<string>, members array<long>, words double, flow array<double>"), "flow")
    return rows
