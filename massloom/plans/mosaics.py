"""Mosaics of customers by nation, segment and balance, masked by large orders, and ordered heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mosaic
from .registry import query, table

# raw members: sets are nations, segments and classes of balance, masks are the priorities and states of large orders
MEMBERS = """m AS (SELECT unnest(['n' || c_nationkey, 's' || c_mktsegment, 'b' || CAST(floor(c_acctbal / 2000) AS BIGINT)]) AS s, c_custkey AS o FROM customer WHERE c_acctbal > 0 OR c_nationkey < 20),
  k AS (SELECT DISTINCT unnest([o_orderpriority, o_orderstatus]) AS k, o_custkey AS o FROM orders WHERE o_totalprice > 200000)"""


def _members(s: SparkSession, d: str) -> DataFrame:
    sets = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), "c_mktsegment"), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 2000).cast("long").cast("string")))
    return table(s, d, "customer").where("c_acctbal > 0 or c_nationkey < 20").select(F.explode(sets).alias("set"), F.col("c_custkey").alias("obj"))


def _masks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_totalprice > 200000").select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("mask"), F.col("o_custkey").alias("obj"))


@query("mosaic_tiles", f"WITH {MEMBERS}, g AS (SELECT o, list(s ORDER BY s) AS l FROM m GROUP BY o) SELECT min(o) AS tile, count(*) AS n, any_value(len(l)) AS n_sets FROM g GROUP BY l")
def mosaic_tiles(s: SparkSession, d: str) -> DataFrame:
    made = mosaic.build(_members(s, d), "set", "obj")
    return made.tiles.join(made.tile_sets.groupBy("tile").agg(F.count("*").alias("n_sets")), "tile").select("tile", "n", "n_sets")


@query("mosaic_weights", f"WITH {MEMBERS}, g AS (SELECT o, list(s ORDER BY s) AS l FROM m GROUP BY o) SELECT min(o) AS tile, count(*) AS n, round(coalesce(sum(p), 0), 4) AS weight FROM g LEFT JOIN (SELECT o_custkey AS c, sum(o_totalprice) AS p FROM orders GROUP BY 1) ON c = o GROUP BY l")
def mosaic_weights(s: SparkSession, d: str) -> DataFrame:
    made = mosaic.build(_members(s, d), "set", "obj")
    prices = table(s, d, "orders").groupBy(F.col("o_custkey").alias("obj")).agg(F.sum("o_totalprice").alias("weight"))
    return mosaic.tile_weights(made, prices).withColumn("weight", F.round("weight", 4))


LOG_TAIL = "round(log10(sum(exp(lgamma(b + 1) - lgamma(i + 1) - lgamma(b - i + 1) + lgamma(t - b + 1) - lgamma(a - i + 1) - lgamma(t - b - a + i + 1) - lgamma(t + 1) + lgamma(a + 1) + lgamma(t - a + 1)))), 5)"

OVERLAPS = f"""{MEMBERS}, t AS (SELECT count(DISTINCT o) AS t FROM m), a AS (SELECT s, count(*) AS a FROM m GROUP BY s), b AS (SELECT k, count(*) AS b FROM k WHERE o IN (SELECT o FROM m) GROUP BY k),
  n AS (SELECT s, k, count(*) AS n FROM m JOIN k USING (o) GROUP BY 1, 2), x AS (SELECT s, k, n, a, b, t FROM n JOIN a USING (s) JOIN b USING (k), t),
  j AS (SELECT *, unnest(range(greatest(n, a + b - t), least(a, b) + 1)) AS i FROM x), p AS (SELECT s, k, n, a, b, least({LOG_TAIL}, 0) + 0.0 AS p FROM j GROUP BY s, k, n, a, b, t)"""


@query("mask_overlaps", f'WITH {OVERLAPS} SELECT s AS "set", k AS mask, n AS nmasked, a - n AS nunmasked, a AS n_set, b AS n_mask, p AS log10_pvalue FROM p')
def mask_overlaps(s: SparkSession, d: str) -> DataFrame:
    got = mosaic.mask_overlaps(mosaic.build(_members(s, d), "set", "obj"), _masks(s, d))
    return got.withColumn("log10_pvalue", F.round("log10_pvalue", 5) + F.lit(0.0))


@query("masked_mosaic", f"""WITH {OVERLAPS}, q AS (SELECT * FROM p WHERE n >= 2), best AS (SELECT s, min(p) AS best FROM q GROUP BY s),
  c AS (SELECT min(c) AS c FROM (SELECT unnest(range(0, 400)) AS c) WHERE (SELECT count(*) FROM best WHERE best <= -0.30103 - c * 0.5) <= 12), kept AS (SELECT s FROM best, c WHERE best <= -0.30103 - c * 0.5),
  g AS (SELECT o, list(s ORDER BY s) AS l FROM m WHERE s IN (SELECT s FROM kept) GROUP BY o) SELECT min(o) AS tile, count(*) AS n, list_aggregate(any_value(l), 'string_agg', ' ') AS sets FROM g GROUP BY l""")
def masked_mosaic(s: SparkSession, d: str) -> DataFrame:
    """Half as the highest p of a set's best; at most 12 sets stay, and their mosaic is made from the tiles of all."""
    left, _, _, _ = mosaic.masked(mosaic.build(_members(s, d), "set", "obj"), _masks(s, d), max_sets=12, max_min_pvalue=0.5)
    named = left.tile_sets.groupBy("tile").agg(F.array_join(F.array_sort(F.collect_list("set")), " ").alias("sets"))
    return left.tiles.join(named, "tile").select("tile", "n", "sets")
