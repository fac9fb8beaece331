"""SimHash near-dedup by the generalised pigeonhole principle.

A 64-bit fingerprint is made of each document's word shingles.  Bits are put into partitions so that
correlated bits lie together; if the thresholds of m partitions add up to tau - m + 1, two fingerprints
within tau bits are within the threshold of at least one partition.  Thresholds are unequal: dynamic
programming picks them to make the estimated number of candidates least.  Fingerprints are probed by
partition value (and the values within the partition's threshold) and every candidate is verified.

A partition's threshold is shared by both sides: each fingerprint stands under every value within half of it (rounded
up) of its own, so two that differ by the threshold meet at a value between.  Equal fingerprints are one row from the
start.  A value with more than ``limit`` fingerprints is probed again by each of tau + 1 parts of the other
bits, of which one must be equal; what is still together, or where such parts are too short to split, is
dealt to pairs of blocks of at most ``limit``.  A task reads its rows sorted by value, a few values at a time, and emits a spanning forest of
the links it finds, at most one row for each fingerprint, never the pairs of a group.

Columns of the input that are called like the operator's own do not clash: only id and text are read here.  Very long texts are
read whole, their bits counted ``CHUNK`` shingles at a time.
Defined cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; no rows give no rows; a component all of whose ids are null has a null name, and counts as one.
Rows repeated with one id are compared by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, least_labels
from ..session import materialize, ship_package
from .rows import few, keyed_texts, least_by_hash, map_batches, unboxed, whole, whole_groups

BITS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Thresholds of one partition at most, and fingerprints that estimate what they cost.
MOST, ESTIMATE_ROWS = 4, 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(whole, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return majority(np.array([h(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    def one(b: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        return {"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "fp": fp}

    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    return map_batches(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), one, "doc_id long, text_hash long, fp long", {"fp": pa.int64()})


def correlated_partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """Equal partitions of the bits: each grows from the free bit that is correlated most, by mean correlation."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(sample) > 2:
        centred = bits - bits.mean(axis=0)
        sd = np.maximum(centred.std(axis=0), 1e-9)
        corr = np.abs(centred.T @ centred / len(bits) / np.outer(sd, sd))
    else:
        corr = np.zeros((BITS, BITS))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for _ in range(m):
        ranked = sorted(free)
        part = [max(ranked, key=lambda b: (corr[b, ranked].max(), -b))]
        free.remove(part[0])
        while len(part) < BITS // m:
            best = max(sorted(free), key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def value_of(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of ``part``, moved together."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(bits: int, radius: int) -> list[int]:
    """Differences of at most ``radius`` of ``bits`` bits, fewest first."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def allocate(sample: np.ndarray, parts: list[list[int]], tau: int, n: int | None = None) -> list[int]:
    """Thresholds of the partitions, -1 (not probed) to ``MOST``, adding up to tau - m + 1, of the least estimated cost.

    The cost is the number of rows that meet under one value, and of rows probed, for ``n`` fingerprints like the sample.
    """
    m, picked = len(parts), sample[:ESTIMATE_ROWS]
    scale = max(1.0, (n or len(picked)) / max(1, len(picked)))
    cost: list[dict[int, float]] = []
    for part in parts:
        value, by = value_of(picked, part), {-1: 0.0}
        for e in range(min(tau, MOST, len(part)) + 1):
            ball = masks(len(part), ceil(e / 2))
            inner = sum(x.bit_count() <= e // 2 for x in ball)
            at = (value[:, None] ^ np.array(ball, np.uint64)).ravel()
            _, where = np.unique(at, return_inverse=True)
            all_, own = np.bincount(where), np.bincount(where, np.tile(np.arange(len(ball)) < inner, len(picked)))
            by[e] = float((all_ * own).sum()) * scale**2 + scale * len(at)
        cost.append(by)
    goal = tau - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for by in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for e, x in by.items():
                if total + e not in step or c + x < step[total + e][0]:
                    step[total + e] = (c + x, [*chosen, e])
        best = step
    if goal not in best:
        raise ValueError(f"{m} partitions cannot hold a tolerance of {tau} bits: take more")
    return best[goal][1]


def linked(
    key: np.ndarray, words: Sequence[np.ndarray], own: np.ndarray, tau: int, size: np.ndarray | None = None, ratio: float = 0.0, tile: int = 2048,
) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning forest of the links between rows of one key, one of them its own.

    Linked are rows whose ``words`` differ by ``tau`` bits at most and whose sizes are within ``ratio`` of each other.
    """
    order = np.lexsort((words[0], key))
    key, words, own = key[order], [w[order] for w in words], own[order]
    size = size[order] if size is not None else None
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = sum(np.bitwise_count(w[a] ^ w[b]) for w in words) <= tau
        a, b = a[ok], b[ok]
        ok = own[a] | own[b]
        if size is not None:
            ok &= np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b]) - 1e-6
        return a[ok], b[ok]

    small = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(small)
    left = np.repeat(starts + sizes, sizes)[at] - at  # rows from this one to the end of its key
    for step in range(1, int(min(64, sizes.max(initial=1)))):  # all small groups at once, by distance in the order
        more = left > step
        at, left = at[more], left[more]
        found.append(near(at, at + step))
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        root = np.arange(n)
        for i in range(0, n, tile):
            for j in range(i, n, tile):
                x, y = slice(s + i, s + min(n, i + tile)), slice(s + j, s + min(n, j + tile))
                a, b = np.nonzero(sum(np.bitwise_count(w[x][:, None] ^ w[y][None, :]) for w in words) <= tau)
                keep = a + i < b + j
                a, b = near(a[keep] + s + i, b[keep] + s + j)
                if len(a):
                    root = least_labels(n, root[a - s], root[b - s])[root]
        at = np.flatnonzero(root != np.arange(n))
        found.append((s + at, s + root[at]))
    a, b = (np.concatenate([f[k] for f in found] or [starts[:0]]) for k in (0, 1))
    label = least_labels(len(key), a, b)
    a = np.flatnonzero(label != np.arange(len(key)))
    return order[a], order[label[a]]


def bits(word: str, part: Sequence[int]):
    """Column: the bits ``part`` of the long ``word``, moved together."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftrightunsigned(word, b).bitwiseAND(F.lit(1).cast("long")), k) for k, b in enumerate(part)])


def probed(rows: DataFrame, word: str, tau: int, m: int, number: int, sample_rows: int) -> DataFrame:
    """``rows`` with their values (key, own) in the partitions of ``word``; a key is a partition's number and a value.

    ``sample_rows`` of them, those of least hash, fit partitions and thresholds; all are probed.
    """
    n = rows.count()
    picked = least_by_hash(rows.select(word), F.xxhash64(word), sample_rows).toPandas()[word].to_numpy(np.int64).view(np.uint64)
    parts = correlated_partitions(picked, m)
    made = []
    for i, (part, e) in enumerate(zip(parts, allocate(picked, parts, tau, n), strict=True)):
        if e < 0:
            continue
        ball = masks(len(part), ceil(e / 2))
        inner = sum(x.bit_count() <= e // 2 for x in ball)
        value = bits(word, part)
        # a function of one small expression: a column for each mask would make the plan many times as large
        near = F.transform(F.array(*[F.lit(x).cast("long") for x in ball]), lambda x: x.bitwiseXOR(value))
        probes = rows.select("*", F.posexplode(near).alias("pos", "v"))
        key = F.shiftleft(F.lit(number * m + i).cast("long"), 56).bitwiseOR(F.col("v"))  # small numbers: they are packed well
        # the bits of other partitions, dealt to tau + 1 parts, tell apart what is together under a hot value
        rest = [b for b in range(BITS) if b not in part]
        chunks = F.array(*[bits(word, rest[c :: tau + 1]) for c in range(tau + 1)]) if 2 ** (len(rest) // (tau + 1)) > 2 * (tau + 1) else F.array().cast("array<bigint>")
        made.append(probes.select(*rows.columns, key.alias("key"), (F.col("pos") < inner).alias("own"), chunks.alias("chunks")))
    return reduce(DataFrame.unionByName, made)


def dealt(rows: DataFrame, limit: int, names: Sequence[str], size: str | None = None, ratio: float = 0.0) -> DataFrame:
    """``rows`` (``names``, key, own, chunks) under values that hold at most about 2 * ``limit`` of them each."""
    done = []
    for stage in ("chunks", "blocks") if size is None else ("chunks", "sizes", "blocks"):
        # at most all rows / limit values
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > limit), "hot")
        if hot.isEmpty():
            break
        marked = rows.join(few(hot), "key", "left")
        done.append(marked.where("many is null").drop("many"))
        rows = marked.where("many is not null")
        if stage == "chunks":
            split = rows.where("size(chunks) > 0").select("*", F.posexplode("chunks").alias("c", "x")).withColumn("key", F.xxhash64("key", "c", "x")).drop("c", "x", "many")
            rows = split.unionByName(rows.where("size(chunks) = 0").drop("many"))
        elif stage == "sizes":
            # sizes within the ratio lie in one band or in two that touch
            band = F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / -np.log(ratio))
            rows = rows.select("*", F.explode(F.array(band, band + 1)).alias("band")).withColumn("key", F.xxhash64("key", "band")).drop("band", "many")
        else:
            blocks = F.ceil(F.col("many") / limit)
            rows = rows.withColumn("b", F.pmod(F.xxhash64(*names), blocks)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("c"))
            rows = rows.withColumn("key", F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c"))).drop("b", "c", "many")
    return reduce(DataFrame.unionByName, done, rows).drop("chunks")


def links_of(rows: DataFrame, names: Sequence[str], words: Sequence[str], tau: int, size: str | None = None, ratio: float = 0.0) -> DataFrame:
    """(a_<name>, b_<name>): what ``linked`` finds among ``rows`` (``names``, longs that tell rows apart, key, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            own = t["own"].to_numpy(zero_copy_only=False).astype(bool)
            ends = linked(t["key"].to_numpy(), [t[w].to_numpy().view(np.uint64) for w in words], own, tau, t[size].to_numpy() if size else None, ratio)
            pairs = np.unique(np.stack([t[c].to_numpy()[e] for e in ends for c in names]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=columns)

    ship_package(rows.sparkSession)
    columns = [f"{e}_{c}" for e in "ab" for c in names]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def near_links(distinct: DataFrame, tau: int = 3, m: int = 4, limit: int = 2000, sample_rows: int = 20_000) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``tau`` bits of each other."""
    rows = probed(distinct.select("fp"), "fp", tau, m, 0, sample_rows)
    return links_of(dealt(rows, limit, ["fp"]), ["fp"], ["fp"], tau).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))


def simhash_components(docs: DataFrame, tau: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id), one row per row of ``docs``; ``component`` is a fingerprint of the group."""
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    links = near_links(distinct.select("fp"), tau, **options)
    parts = connected_components(links, "a", "b").withColumnRenamed("id", "fp")
    # the component's name is its smallest document
    joined = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(joined.join(names, "component").select("fp", "component", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return simhash_components(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: that of least id (null ids last), then least hash of the text."""
    return keep_one(docs, simhash_components(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def keep_one(docs: DataFrame, comp: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` that stays of each component; ``comp``: (doc_id, text_hash, component) of every row.

    Of rows that repeat both id and text one stays.  Only rows that go, or repeat, are joined to ``docs``.
    """
    rows = materialize(comp.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
    keep = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"), F.sum("n").alias("all")).where("`all` > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    marks = rows.join(few(materialize(keep, "keep")), "component").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("_stays"), F.col("n").alias("_rows"))
    marks = materialize(marks.where("not _stays or _rows > 1"), "marks")
    own = docs.select(whole(docs).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    joined = own.join(few(marks), own["id"].eqNullSafe(marks["_id"]) & (own["hash"] == marks["_hash"]), "left")
    # rows that repeat both id and text are rare: only they pay for another shuffle
    once = joined.where("_stays is null").unionByName(joined.where("_stays").dropDuplicates(["id", "hash"]))
    return unboxed(once, docs)
