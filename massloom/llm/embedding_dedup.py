"""Embedding near-dedup by product quantisation with inverted lists.

Coarse centroids and codebooks of residual subspaces are fitted on a bounded sample; every vector is indexed: put in the
list of its nearest centroid and coded.  Every vector is also a query: it probes its own list and each list whose boundary
lies within half the link distance, gets asymmetric distances by table lookup, keeps candidates that the code's own error leaves
possible, and reranks them by exact cosine in double precision.

No link is lost: two vectors at link distance in different lists have the boundary of these between them, so one of the two at least is within
half that distance of it and probes the other's list.  A link that one side alone can find is counted for both ends, one that both find for
each by itself.  Codes are compared with their error added, so no candidate is dropped that the rerank would keep.

Lists are per label and dimension, and their number grows with the rows, to ``MAX_LISTS``.  Equal vectors are one row from
the start.  A list's members are dealt to blocks of ``block``, its queries to blocks of ``query_block``; a task holds one block of members and streams
the queries past it, and emits counts and a spanning forest, never the pairs of a list.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors of null label or id, link
with nothing and are components of their own; vectors of different dimension never link; rows repeated with one id
are separate vectors of one component; no rows give no rows.  Only id, vector and label are read, so no other column clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, least_labels
from ..session import materialize, ship_package
from .rows import least_by_hash

#: Rows whose distances to all centroids are held at once.
SLICE = 2048
#: Vectors that fit the index at most (those of least hash), vectors of the sample for a list, and lists of a dimension at most.
SAMPLE_ROWS, PER_LIST, MAX_LISTS = 32_768, 32, 1024
SUBSPACES, CODES = 8, 64


@dataclass
class Quantiser:
    """Coarse centroids, and for each subspace (a slice of the dimensions) its codebook of residuals."""

    centroids: np.ndarray
    slices: list[slice]
    books: list[np.ndarray]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances to centroids, nearest list) of at most ``SLICE`` vectors."""
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1), 0)
        return d, d.argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between vector and its reconstruction)."""
        rest = x - self.centroids[lists]
        codes = np.empty((len(x), len(self.slices)), np.uint8)
        for m, (s, book) in enumerate(zip(self.slices, self.books, strict=True)):
            part = rest[:, s]
            codes[:, m] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            rest[:, s] = part - book[codes[:, m]]
        return codes, np.sqrt((rest * rest).sum(1))

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """(subspaces, codes, queries): squared distances of the query's residual in list ``at`` to each code."""
        rest = q - self.centroids[at]
        out = np.zeros((len(self.slices), CODES, len(q)), np.float32)
        for m, (s, book) in enumerate(zip(self.slices, self.books, strict=True)):
            part = rest[:, s]
            out[m, : len(book)] = np.maximum((part * part).sum(1) - 2 * book @ part.T + (book**2).sum(1)[:, None], 0)
        return out

    def probes(self, x: np.ndarray, d: np.ndarray, lists: np.ndarray, margin: float) -> list[np.ndarray]:
        """Lists of which each vector is within ``margin`` of the boundary, its own with them."""
        c = self.centroids
        norms = (c * c).sum(1)
        gaps = np.sqrt(np.maximum(norms[lists][:, None] + norms - 2 * c[lists] @ c.T, 0))
        at = np.arange(len(x))
        near = d - d[at, lists][:, None] <= 2 * gaps * margin + 1e-9
        near[at, lists] = True
        return [np.flatnonzero(r).astype(np.int32) for r in near]


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[lo : lo + SLICE] @ c.T).argmin(1) for lo in range(0, len(x), SLICE)])
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def flat(dim: int) -> Quantiser:
    """One list, one code: for dimensions that the sample has not seen."""
    return Quantiser(np.zeros((1, dim)), [slice(0, dim)], [np.zeros((1, dim))])


def fit(x: np.ndarray, seed: int = 3) -> Quantiser:
    """Fits on unit vectors: a list for ``PER_LIST`` vectors of the sample."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(MAX_LISTS, len(x) // PER_LIST))
    centroids = k_means(x, lists, 8, rng)
    model = Quantiser(centroids, [], [])
    rest = x - centroids[np.concatenate([model.assign(x[lo : lo + SLICE])[1] for lo in range(0, len(x), SLICE)])]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    model.slices = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    model.books = [k_means(np.ascontiguousarray(rest[:, s]), min(CODES, len(x)), 8, rng) for s in model.slices]
    return model


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their greatest component first, so that no square leaves the range of doubles."""
    y = x / np.abs(x).max(1)[:, None]
    return y / np.linalg.norm(y, axis=1)[:, None]


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Binary rows of doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


class Members:
    """One block of a list's members, past which queries are streamed."""

    def __init__(self, model: Quantiser, at: int, dim: int, rows: pa.Table) -> None:
        self.model, self.at, self.dim = model, at, dim
        self.y = unit(vectors(rows["v"], dim))
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
        self.err, self.ids, self.copies = rows["err"].to_numpy(), rows["rep"].to_numpy(), rows["copies"].to_numpy()
        probes = rows["probes"].to_pylist()
        # (member, list that it probes) as one number, sorted
        self.asks = np.array([k * len(model.centroids) + p for k, own in enumerate(probes) for p in own], np.int64)

    def links(self, queries: pa.Table, cosine: float, reach: float) -> tuple[np.ndarray, ...]:
        """(vector, links) of both ends, and a spanning forest (vector, root)."""
        ids, home, copies = queries["rep"].to_numpy(), queries["home"].to_numpy(), queries["copies"].to_numpy()
        x = unit(vectors(queries["v"], self.dim))
        limit = ((reach + self.err) ** 2 * (1 + 1e-5) + 1e-6).astype(np.float32)[:, None]
        nodes, place = np.unique(np.concatenate([self.ids, ids]), return_inverse=True)
        count, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for lo in range(0, len(x), 256):
            q = x[lo : lo + 256]
            tables = self.model.tables(q, self.at)
            approx = tables[0][self.codes[:, 0]]
            for m in range(1, len(tables)):
                approx += tables[m][self.codes[:, m]]
            b, a = np.nonzero(approx <= limit)
            sim = np.empty(len(a))
            for c in range(0, len(a), 1 << 16):  # bounded memory for a dense block
                sim[c : c + (1 << 16)] = np.einsum("ij,ij->i", q[a[c : c + (1 << 16)]], self.y[b[c : c + (1 << 16)]])
            ok = (sim >= cosine) & (ids[lo + a] != self.ids[b])
            a, b = a[ok] + lo, b[ok]
            if not len(a):
                continue
            pa_, pb = place[len(self.ids) + a], place[b]
            np.add.at(count, pa_, self.copies[b])
            asked = b * len(self.model.centroids) + home[a]
            found = np.searchsorted(self.asks, asked)
            alone = self.asks[np.minimum(found, len(self.asks) - 1)] != asked  # the member does not probe the query's list
            np.add.at(count, pb[alone], copies[a[alone]])
            root = least_labels(len(nodes), root[pa_], root[pb])[root]
        keep = (count > 0) | (root != np.arange(len(nodes)))
        return nodes[keep], count[keep], nodes[root[keep]]


def embedding_dedup(
    rows: DataFrame, cosine: float = 0.98, block: int = 8192, query_block: int = 1 << 18, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    ship_package(spark)
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    named = materialize(named.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit("second"), "label", "v")), "vectors")
    own = named.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = materialize(own, "reps")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(v).tobytes() for v in b.column("v").to_pylist()], pa.binary())], names=["v"])

    sample = [r["v"] for r in least_by_hash(reps.select("h1", "v"), F.col("h1"), sample_rows).select("v").mapInArrow(packed, "v binary").collect()]
    models = {}
    for size in sorted(set(map(len, sample))):
        models[size // 8] = fit(unit(np.frombuffer(b"".join(v for v in sample if len(v) == size), np.float64).reshape(-1, size // 8)))
    del sample
    reach = math.sqrt(2 - 2 * cosine)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            dims = np.diff(v.offsets.to_numpy())
            for dim, lo in [(dim, lo) for dim in np.unique(dims).tolist() for lo in range(0, (dims == dim).sum(), SLICE)]:
                at = np.flatnonzero(dims == dim)[lo : lo + SLICE]
                model, rest = models.get(dim) or flat(dim), b.take(pa.array(at))
                x = rest.column("v").flatten().to_numpy().reshape(-1, dim)
                u = unit(x)
                d, lists = model.assign(u)
                codes, err = model.encode(u, lists)
                probes = model.probes(u, d, lists, reach / 2)
                names = ["rep", "copies", "label", "v", "dim", "home", "codes", "err", "probes"]
                made = [rest.column("rep"), rest.column("copies"), rest.column("label"), pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float64)], pa.binary()), pa.array(np.full(len(at), dim), pa.int32()),
                        pa.array(lists, pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(err, pa.float64()), pa.array(probes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "rep long, copies long, label string, v binary, dim int, home int, codes binary, err double, probes array<int>"
    indexed = materialize(reps.select("rep", "copies", "label", "v").mapInArrow(index, schema), "indexed")
    cell = ["label", "dim", "at"]
    members = indexed.withColumn("at", F.col("home"))
    queries = indexed.select("rep", "copies", "label", "v", "dim", "home", F.explode("probes").alias("at"))
    sizes = members.groupBy(*cell).agg(F.count("*").alias("n")).join(queries.groupBy(*cell).agg(F.count("*").alias("nq")), cell)
    sizes = materialize(sizes.select(*cell, F.ceil(F.col("n") / block).cast("int").alias("mb"), F.ceil(F.col("nq") / query_block).cast("int").alias("qb")), "cells")

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row once for each block of the other side."""
        k = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        return side.join(sizes, cell).withColumn(mine, k).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    both = dealt(members, "mb", "qb").withColumn("query", F.lit(False)).unionByName(dealt(queries, "qb", "mb").withColumn("query", F.lit(True)), allowMissingColumns=True)
    both = both.select(F.concat_ws(" ", "dim", "at", "mb", "qb", "label").alias("key"), "query", "rep", "copies", "v", "home", "codes", "err", "probes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block_ = None, [], None
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            asks = b.column("query").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if keys[lo] != key:
                    key, held, block_ = keys[lo], [], None
                if not asks[lo]:
                    held.append(part)
                elif held:
                    if block_ is None:
                        dim, at = map(int, key.split(" ", 2)[:2])
                        block_ = Members(models.get(dim) or flat(dim), at, dim, pa.Table.from_batches(held))
                    made = block_.links(pa.Table.from_batches([part]), cosine, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["rep", "links", "root"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(both.repartition(n, "key").sortWithinPartitions("key", "query").mapInArrow(compare, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("id", "rep")
    done = materialize(reps.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left"), "named")
    done = done.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = named.where("fine").select("vec_id", "h1", "h2").join(done, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = named.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
