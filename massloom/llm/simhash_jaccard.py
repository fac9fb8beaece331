"""SimHash near-dedup for a given Jaccard similarity of word shingles.

Two fingerprints of 64 bits each are made of a document's ``probe_words``-word shingles.  Both are probed by the
generalised pigeonhole of ``simhash`` within ``tau`` bits; what meets and is within ``far`` of all 128 bits, and of sizes that
allow the similarity, is a candidate.  Candidates make groups; inside a group links are verified by the similarity of the
sets of ``width``-word shingles of the whole texts (by 64-bit hashes), so no pair below the threshold is ever linked.

A pair of similarity 0.8 differs by about 8 of 64 bits by three-word shingles; within 11 bits in one of two fingerprints are
0.997 of all such pairs on the check tables, and 0.999 of the documents that go are found (by brute force over min-hash
candidates).  That share is the recall: the probing itself loses none.

Groups over ``limit`` documents are first compared with one centre, the member nearest to the bitwise majority of those
that are not yet in the group's largest component, for ``rounds`` rounds, so that a large group of near copies
costs a row for each copy and not its pairs.  Those still outside of that component are active.  Active members are compared with one another and
with the rest in blocks of ``block``: a task holds two blocks, counts common shingles by a product of matrices, and emits a spanning
forest of the links it finds, never pairs.

Defined cases: null and empty texts have the empty set, equal to one another and similar to nothing else; texts of fewer words
than a shingle are one shingle; equal sets are one vertex; rows repeated are of one component; no rows give no rows.  Only id and text
are read here, so no other column clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, least_labels
from ..session import materialize, ship_package
from .rows import few, keyed_texts, map_batches, whole_groups
from .simhash import BITS, dealt, keep_one, links_of, majority, probed

WORDS = ["fp", "fp2"]
CARRIED, MET = ["id", "n", *WORDS], [*WORDS, "n"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each shingle, repeats included."""
    k = min(width, len(word_hashes))
    n = len(word_hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : j + n]
    return mixed(out, 0xD6E8FEB86659FD93)


def shingle_members(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = words_of(text)
    return np.unique(shingle_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), width)) if words else np.empty(0, np.uint64)


def sketch(text: str | None, width: int, probe_words: int) -> tuple[int, int, int, int]:
    """(name of the shingle set, its size, both fingerprints), signed."""
    words = words_of(text)
    if not words:
        return 0, 0, 0, 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    members = np.unique(shingle_hashes(h, width))
    grams = shingle_hashes(h, probe_words)
    values = np.array([xxhash.xxh64_intdigest(members.tobytes(), 42), majority(grams), majority(mixed(grams, 0xA24BAED4963EE407))], np.uint64)
    name, fp, fp2 = values.view(np.int64).tolist()
    return name, len(members), fp, fp2


def sketches(docs: DataFrame, width: int, probe_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, id, n, fp, fp2) of every row; ``id`` names the set of its shingles."""
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def one(b: pa.RecordBatch) -> dict:
        made = np.array([sketch(t, width, probe_words) for t in b.column("text").to_pylist()], np.int64).reshape(-1, 4)
        return {"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash")} | {c: made[:, k] for k, c in enumerate(CARRIED)}

    return map_batches(texts, one, "doc_id long, text_hash long, id long, n long, fp long, fp2 long", dict.fromkeys(CARRIED, pa.int64()))


def shingle_rows(docs: DataFrame, members: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the sorted hashes of the shingles, as bytes, of the documents in ``members`` (id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_members(t, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "s"])

    wanted = materialize(members.select("text_hash", "id"), "wanted")
    texts = keyed_texts(docs, id_col, text_col).select(F.xxhash64("text").alias("text_hash"), "text").join(few(wanted), "text_hash").select("id", "text")
    return texts.mapInArrow(run, "id long, s binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sa, sb = shingles.select(F.col("id").alias("a"), F.col("s").alias("sa")), shingles.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return materialize(pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


#: Shingles whose counts are multiplied at once.
COLUMNS = 1 << 13


def similar(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets (sorted, distinct) that reach the threshold: what they share, counted by products of matrices."""
    n = np.array([len(x) for x in sets])
    values, where, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in one set alone
    column = np.cumsum(shared) - 1
    row, keep = np.repeat(np.arange(len(sets)), n), shared[where]
    row, column = row[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    either = np.maximum(n[:, None] + n - both, 1)
    a, b = np.nonzero(np.triu(both >= threshold * either - 1e-9, 1))
    return a, b


def block_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the links among ``rows`` (key, id, s) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 512):
            key, ids = t["key"].to_numpy(), t["id"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                a, b = similar(sets[lo:hi], threshold)
                label = least_labels(hi - lo, a, b)
                at = np.flatnonzero(label != np.arange(hi - lo))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + at]), pa.array(ids[lo + label[at]])], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"), "links")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """(key, id): each pair of an active member (g, id, active) and another of its group is together under a key, with some 2 * ``block`` rows."""
    blocks = lambda c: F.greatest(F.ceil(F.count_if(c) / block), F.lit(1))
    sizes = members.groupBy("g").agg(blocks(F.col("active")).alias("na"), blocks(~F.col("active")).alias("np"))
    rows = members.join(sizes, "g").withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("active"), F.col("na")).otherwise(F.col("np"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = rows.where("active").select("g", "id", "at", "na", "np", F.explode(upto("na")).alias("k"))
    own = mine.select(F.xxhash64("g", F.lit("active"), F.least("at", "k"), F.greatest("at", "k")).alias("key"), "id")
    rest = rows.join(rows.where("not active").select("g").distinct(), "g", "left_semi")
    others = rest.where("active").select(F.explode(upto("np")).alias("k"), "g", "at", "id").select(F.xxhash64("g", F.lit("rest"), "at", "k").alias("key"), "id")
    passive = rest.where("not active").select(F.explode(upto("na")).alias("k"), "g", "at", "id").select(F.xxhash64("g", F.lit("rest"), "k", "at").alias("key"), "id")
    return own.unionByName(others).unionByName(passive)


def most_of(rows: DataFrame) -> DataFrame:
    """(g, most): the label that most rows of a group have."""
    return rows.groupBy("g", "label").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("most"))


def centre_pairs(rows: DataFrame, far: int, threshold: float) -> DataFrame:
    """(a, b): in each group ``g`` a centre with the candidates of other labels."""
    ones = [F.avg(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(BITS)]
    rest = rows.join(most_of(rows), "g").where("label <> most")
    middle = rest.groupBy("g").agg(*ones)
    value = F.lit(0).cast("long")
    for b in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0.5, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(0))
    middle = middle.select("g", value.alias("middle"))
    centre = rest.join(middle, "g").groupBy("g").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("d"), "id", "label", *WORDS, "n")).alias("c"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) + F.bit_count(F.col("fp2").bitwiseXOR(F.col("c.fp2"))) <= far
    alike = F.least("n", "c.n") >= F.greatest("n", "c.n") * threshold - 1e-6
    return rows.join(centre, "g").where((F.col("label") != F.col("c.label")) & apart & alike).select(F.col("c.id").alias("a"), F.col("id").alias("b"))


def near_components(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, probe_words: int = 3, tau: int = 11, far: int = 28, m: int = 4, limit: int = 1024, block: int = 256, rounds: int = 2, hot: int = 2000,
    sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, component) of every row: components of the verified links."""
    sets = materialize(sketches(docs, width, probe_words, id_col, text_col), "sets")
    vertices = materialize(sets.groupBy("id").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("text_hash").alias("text_hash")), "vertices")
    # candidates: what meets under a value of either fingerprint
    by = [probed(vertices.select(*MET), w, tau, m, k, sample_rows) for k, w in enumerate(WORDS)]
    forest = links_of(dealt(by[0].unionByName(by[1]), hot, MET, "n", threshold), MET, WORDS, far, "n", threshold)
    # sets that meet are told apart by what was probed: those that have all of it in common share a name, and their group
    named = lambda end: F.xxhash64(*[f"{end}{c}" for c in MET])
    forest = materialize(forest.select(named("a_").alias("a"), named("b_").alias("b")).distinct(), "forest")
    alike = vertices.groupBy(named("").alias("a")).agg(F.count("*").alias("k")).where("k > 1").select("a", F.col("a").alias("b"))
    groups = connected_components(forest.unionByName(alike), "a", "b").withColumnRenamed("component", "g").withColumnRenamed("id", "met")
    members = materialize(vertices.withColumn("met", named("")).join(few(groups), "met").drop("met").withColumn("label", F.col("id")), "members")
    shingles = shingle_rows(docs, members, width, id_col, text_col)  # of those documents alone whose group has others
    sizes = materialize(members.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > limit), "sizes")
    large = members.join(few(sizes), "g")
    if not sizes.isEmpty():  # read more than once
        shingles = materialize(shingles, "shingles")
    links = None
    for _ in range(0 if sizes.isEmpty() else rounds):
        found = verified(centre_pairs(large, far, threshold), shingles, threshold)
        links = found if links is None else links.unionByName(found)
        parts = connected_components(links, "a", "b").withColumnRenamed("component", "label")
        large = materialize(large.drop("label").join(few(parts), "id", "left").withColumn("label", F.coalesce("label", "id")), "large")
    rows = members.join(few(sizes), "g", "left_anti").select("g", "id", F.lit(True).alias("active"))
    if links is not None:
        rows = rows.unionByName(large.join(most_of(large), "g").select("g", "id", (F.col("label") != F.col("most")).alias("active")))
    found = block_links(in_blocks(rows, block).join(shingles, "id"), threshold)
    parts = connected_components(found if links is None else links.unionByName(found), "a", "b")
    return sets.select("doc_id", "text_hash", "id").join(few(parts), "id", "left").select("doc_id", "text_hash", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: that of least id (null ids last), then least hash of the text."""
    return keep_one(docs, near_components(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)
