"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after deleting white space (``[\\x20\\x09-\\x0D]``).  Input comes to the index in batches.  A
batch is reduced to one candidate per digest by an aggregation with map-side combine (a hot text costs one partial row per
task), the candidates are taken against the index by a sort-merge anti-join in which the index side needs no shuffle, and what
is new is appended under the batch's name.  One call deals its rows to ``batches`` batches by length, longest originals
first, so the row of a text that has most code points reaches the index before the others.  Digests are 32 bytes; only they, ids
and lengths are shuffled, and texts only where more rows go than may be broadcast.

A job that died is run again with the name it gave as ``batch``: what it had appended counts as its own, so it returns the
same rows.

Defined cases: a null text is an empty text; empty and white-space-only texts are equal to each other;
of equal texts in a call the row with the most code points in the original, then the smallest id (null last), stays, and of
rows that repeat both one stays; a text that an earlier call put in the index keeps that call's id.  An empty table
gives no rows.  Rows repeated with one id count in ``group_size`` each.  Only id and text are read, and whole rows are boxed, so no
other column clashes.  Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, fresh_path, materialize
from .rows import few, unboxed, whole

BLANKS = r"[\x20\x09-\x0D]+"
#: About what a row of the index takes, and what a bucket should hold.
ROW_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 80, 128 << 20, 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def n_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


class DigestIndex:
    """Table (digest, keep_id, batch) under ``path``: Parquet, bucketed and sorted by digest.

    ``path`` outlives the session; opening it again continues the index, with the number of buckets it was made with.
    Tables of one index lie in folders gen-0, gen-1, ...: ``compact`` writes the next with one sorted file for each bucket,
    and the newest that was written whole is the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, expected_rows: int = 0) -> None:
        self.spark, self.path = spark, path
        found = self._generations()
        self.generation, self.buckets = max(found.items()) if found else (0, buckets or max(LEAST_BUCKETS, math.ceil(expected_rows * ROW_BYTES / BUCKET_BYTES)))
        self._open()

    def _folder(self, generation: int) -> str:
        return f"{self.path}/gen-{generation}-{self.buckets}"

    def _generations(self) -> dict[int, int]:
        """Buckets of each generation; one that compaction left unfinished does not count."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        split = [(n, n.getName().split("-")) for n in names]
        return {int(g[1]): int(g[2]) for n, g in split if g[0] == "gen" and (g[1] == "0" or fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))}

    def _open(self) -> None:
        folder = self._folder(self.generation)
        self.name = "massloom_index_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, best: DataFrame, batch: str) -> None:
        """Append those (digest, keep_id) whose digest the index lacks."""
        new = best.select("digest", "keep_id").join(self.table().hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        new.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """One sorted file for each bucket again, so that the anti-join sorts nothing; run now and then between batches."""
        old, folder = self.name, self._folder(self.generation)
        rows = self.table().repartition(self.buckets, "digest")
        self.generation += 1
        name = "massloom_index_" + hashlib.md5(self._folder(self.generation).encode()).hexdigest()
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._folder(self.generation)).mode("overwrite").saveAsTable(name)
        self.name = name
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        delete_path(self.spark, folder)

    def close(self) -> None:
        """Forget the name in this session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest, n_points) of every row; ``row`` numbers them apart."""
    text = F.col(text_col)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_digest(text).alias("digest"), n_points(text).alias("n_points"))


def best_of_batch(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, rows): one row per digest."""
    order = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = keyed.groupBy("digest").agg(F.min(order).alias("b"), F.count("*").alias("rows"))
    return best.select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), "rows")


def indexed(keyed: DataFrame, index: DigestIndex | None, batch: str | None, batches: int) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of every digest in ``keyed``, after all its batches went into the index.

    ``keep_row`` is null where an earlier call holds the text.
    """
    spark = keyed.sparkSession
    own = index is None
    index = index or DigestIndex(spark, fresh_path(spark, "digests"), expected_rows=keyed.count())
    batch = batch or uuid.uuid4().hex
    cuts = keyed.agg(F.percentile_approx("n_points", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    made = []
    for k, (most, least) in enumerate(zip(edges, edges[1:], strict=False)):
        part = keyed if most is None else keyed.where(F.col("n_points") < most)
        part = part if least is None else part.where(F.col("n_points") >= least)
        best = materialize(best_of_batch(part), "best")
        index.add(best, f"{batch}/{k}")
        made.append(best.withColumn("k", F.lit(k)))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    sizes = every.groupBy("digest").agg(F.min(F.struct("k", "keep_row")).alias("b"), F.sum("rows").alias("group_size"))
    mine = F.col("batch") == F.concat(F.lit(f"{batch}/"), F.col("b.k").cast("string"))
    joined = sizes.join(index.table().hint("merge"), "digest").select("digest", "keep_id", F.when(mine, F.col("b.keep_row")).alias("keep_row"), "group_size")
    done = materialize(joined, "indexed")
    if own:
        index.close()
    return done


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Without an ``index`` a new one is made in the shared folder.
    """
    keyed = materialize(digests(docs, id_col, text_col), "keyed")
    found = indexed(keyed, index, batch, batches)
    # both sides are plain tables, so a hot digest's rows are dealt to several tasks
    return keyed.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, batches: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, one for each new digest, with the columns of ``docs``."""
    keyed = materialize(digests(docs, id_col, text_col), "keyed")
    found = indexed(keyed, index, batch, batches).where("group_size > 1 or keep_row is null").select("digest", "keep_row")
    # marked are rows that go, and rows that stay but have others like them in id and length; of those the first is the one that stays
    alike = materialize(keyed.groupBy("digest", "doc_id", "n_points").agg(F.count("*").alias("_rows"), F.min("row").alias("first")), "alike")
    rows = alike.join(few(found), "digest").withColumn("_stays", F.coalesce(F.col("first") == F.col("keep_row"), F.lit(False)))
    marks = materialize(rows.where("not _stays or _rows > 1").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), F.col("n_points").alias("_points"), "_stays"), "marks")
    text = F.col(text_col)
    mine = docs.select(whole(docs).alias("doc"), F.col(id_col).cast("long").alias("id"), text_digest(text).alias("digest"), n_points(text).alias("points"))
    met = (mine["digest"] == marks["_digest"]) & mine["id"].eqNullSafe(marks["_id"]) & (mine["points"] == marks["_points"])
    joined = mine.join(few(marks), met, "left")
    # rows repeated with one id and length are rare: only they pay for another shuffle
    once = joined.where("_stays is null").unionByName(joined.where("_stays").dropDuplicates(["digest"]))
    return unboxed(once, docs)
