"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into memory-sized buckets by seeded hashes; pass two puts each bucket in
canonical order, shuffles it by Fisher-Yates with a seed of its own, and writes it.  The shard of a row is
the best of ``n_shards`` seeded hashes of its id (rendezvous hashing), so id and shard count alone decide,
and one more shard takes rows only into itself.  The bucket comes of the row itself: of its id, its text and its place in the
input.  So rows of one id, or without an id, and rows that repeat spread over all buckets of their shard, and a bucket
holds about ``bucket_bytes`` whatever the keys are.  A task that is lost is made again alike, for places do not change; an input that
is split in another way gives another order, and the same shards.

Defined cases: a null text has 0 bytes; rows repeated with one id share a shard; no rows give no files.
A null id is hashed as such.  Columns are written as doc_<name>, so none clashes.  A very long text is one row of its bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """0 to n_shards - 1, by rendezvous hashing."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))))
    return best["s"]


def byte_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 8, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 48 << 20,
) -> DataFrame:
    """Write ``docs`` under ``path`` in shuffled order; return what was written, with shard, bucket and place.

    Files lie in one folder by shard; within a shard the order is (bucket, place).  Columns of ``docs`` are written as
    doc_<name>, which no other column is called.  ``bucket_bytes`` bounds what one task shuffles in memory.
    """
    spark = docs.sparkSession
    # the largest shard decides how many buckets there are: one id may have many rows
    sizes = docs.groupBy(shard_of(F.col(f"`{id_col}`"), n_shards, seed)).agg(F.sum(byte_size(F.col(f"`{text_col}`"))).alias("b"))
    per_shard = max(4, math.ceil((sizes.agg(F.max("b")).first()[0] or 0) / bucket_bytes))
    named = docs.select(*[F.col(f"`{c}`").alias(f"doc_{c}") for c in docs.columns])
    key = F.col(f"doc_{id_col}")
    placed = named.withColumn("shard", shard_of(key, n_shards, seed)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), key, F.col(f"doc_{text_col}"), F.monotonically_increasing_id()), F.lit(per_shard)).cast("int"))
    first = [f"doc_{id_col}", f"doc_{text_col}"]
    flat = [f.name for f in named.schema.fields if f.name not in first and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "string", "boolean", "date")]

    def shuffle(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[(c, "ascending") for c in [*first, *flat]])  # the same after a lost task
        rng = np.random.Generator(np.random.PCG64([seed, group["shard"][0].as_py(), group["bucket"][0].as_py()]))
        shuffled = group.take(order.take(pa.array(rng.permutation(len(group)))))  # Fisher-Yates
        return shuffled.append_column("place", pa.array(np.arange(len(group)), pa.int64()))

    schema = placed.withColumn("place", F.lit(0).cast("long")).schema
    placed.groupBy("shard", "bucket").applyInArrow(shuffle, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def slots(written: DataFrame) -> DataFrame:
    """``written`` with its slot: the place within the shard, gapless from 0.

    Bucket sizes are added up per shard over a table of one row for each bucket.
    """
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = sizes.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    return written.join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("place")).drop("first")


def sharding(docs: DataFrame, n_shards: int = 8, seed: int = 5, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, read back from the shards."""
    written = write_shards(docs, path or fresh_path(docs.sparkSession, "shards"), n_shards, seed)
    text = F.coalesce("doc_text", F.lit(""))
    slim = written.select(F.col("doc_doc_id").alias("doc_id"), byte_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "bucket", "place")
    return slots(slim).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), n_shards + 1, seed).alias("grown_shard"))
