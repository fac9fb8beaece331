"""Mosaics of set collections: disjoint tiles, and what masks cover of sets by tiles (O1, O3).

A tile holds the objects that are in exactly the same sets.  Sets, masks and their overlaps are sums over tiles, so after one pass
over members and one over masks the work grows with tiles and no longer with objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sets import automask, set_counts, with_pvalue


@dataclass(frozen=True)
class Mosaic:
    """Tables of a mosaic, written once.

    ``tiles`` (tile, n): a tile is named by its least object; ``tile_sets`` (tile, set); ``objects`` (obj, tile);
    ``sets`` (set, n_set, n_tiles[, relevance]).
    """

    tiles: DataFrame
    tile_sets: DataFrame
    objects: DataFrame
    sets: DataFrame

    def total(self) -> int:
        """Objects of all tiles."""
        return self.tiles.agg(F.sum("n")).first()[0] or 0


def build(members: DataFrame, set_col: str, obj_col: str, reference: DataFrame | None = None, reference_members: DataFrame | None = None) -> Mosaic:
    """O1: the mosaic of ``members`` (set, obj); null sets and objects do not count, repeated members count once.

    An object's signature is a digest of its sorted sets, so a row is narrow however many sets it is in.  With ``reference`` (obj) sets have a
    relevance: log10 of the hypergeometric tail for the reference objects among those of ``reference_members`` (by default ``members``).
    """
    rows = materialize(members.select(F.col(set_col).alias("set"), F.col(obj_col).alias("obj")).where("set is not null and obj is not null").distinct(), "members")
    signature = F.unhex(F.sha2(F.to_json(F.struct(F.array_sort(F.collect_set("set")).alias("s"))), 256))
    signed = materialize(rows.groupBy("obj").agg(signature.alias("signature")), "signed")
    named = signed.groupBy("signature").agg(F.min("obj").alias("tile"), F.count("*").alias("n"))
    named = materialize(named, "tiles")
    objects = materialize(signed.join(named, "signature").select("obj", "tile"), "objects")
    tile_sets = materialize(rows.join(named.select(F.col("tile").alias("obj")), "obj", "left_semi").select(F.col("obj").alias("tile"), "set"), "tile_sets")
    sizes = tile_sets.join(named, "tile").groupBy("set").agg(F.sum("n").alias("n_set"), F.count("*").alias("n_tiles"))
    if reference is not None:
        known = members if reference_members is None else reference_members
        known = known.select(F.col(set_col).alias("set"), F.col(obj_col).alias("obj")).where("set is not null and obj is not null")
        marks = reference.select(F.col(obj_col).alias("obj")).where("obj is not null").distinct()
        counts = set_counts(known, known.select("obj").distinct(), marks, "set", "obj")
        relevant = with_pvalue(counts, "n_both", "n_set", "n_hit", "n_all", "relevance").select("set", "relevance")
        sizes = sizes.join(relevant, "set", "left")
    return Mosaic(named.select("tile", "n"), tile_sets, objects, materialize(sizes, "sets"))


def tile_weights(mosaic: Mosaic, weights: DataFrame, weight_col: str = "weight") -> DataFrame:
    """(tile, n, weight): the sum of the weights (obj, weight) of a tile's objects; objects without one weigh nothing."""
    got = weights.select("obj", F.col(weight_col).cast("double").alias("w")).join(mosaic.objects, "obj").groupBy("tile").agg(F.sum("w").alias("weight"))
    return mosaic.tiles.join(got, "tile", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mask_tiles(mosaic: Mosaic, masks: DataFrame, mask_col: str, obj_col: str) -> DataFrame:
    """(tile, mask, nmasked): objects of each tile that a mask (mask, obj) holds; objects outside of the mosaic are left out."""
    rows = masks.select(F.col(mask_col).alias("mask"), F.col(obj_col).alias("obj")).where("mask is not null").distinct()
    return rows.join(mosaic.objects, "obj").groupBy("tile", "mask").agg(F.count("*").alias("nmasked"))


def mask_overlaps(mosaic: Mosaic, masks: DataFrame, mask_col: str = "mask", obj_col: str = "obj") -> DataFrame:
    """O3: (set, mask, nmasked, nunmasked, n_set, n_mask, log10_pvalue) of sets and masks that meet.

    The p-value is the hypergeometric upper tail: at least ``nmasked`` of the set's objects among the mask's, out of all of the mosaic.
    """
    by_tile = materialize(mask_tiles(mosaic, masks, mask_col, obj_col), "masked")
    n_mask = by_tile.groupBy("mask").agg(F.sum("nmasked").alias("n_mask"))
    met = by_tile.join(mosaic.tile_sets, "tile").groupBy("set", "mask").agg(F.sum("nmasked").alias("nmasked"))
    rows = met.join(mosaic.sets.select("set", "n_set"), "set").join(n_mask, "mask").withColumn("total", F.lit(mosaic.total()).cast("long"))
    rows = with_pvalue(rows, "nmasked", "n_set", "n_mask", "total")
    return rows.select("set", "mask", "nmasked", (F.col("n_set") - F.col("nmasked")).alias("nunmasked"), "n_set", "n_mask", "log10_pvalue")


def masked(mosaic: Mosaic, masks: DataFrame, mask_col: str = "mask", obj_col: str = "obj", **limits) -> tuple[Mosaic, DataFrame, float, float]:
    """O3: (mosaic of the sets that are left, their overlaps, both thresholds of log10 p).

    ``limits`` are those of ``automask``.  Tiles that the sets left no longer tell apart become one.
    """
    overlaps = materialize(mask_overlaps(mosaic, masks, mask_col, obj_col), "overlaps")
    kept, least, most = automask(overlaps, "set", "log10_pvalue", "nmasked", "n_set", **limits)
    kept = materialize(kept, "kept")
    return restricted(mosaic, kept.select("set").distinct()), kept, least, most


def restricted(mosaic: Mosaic, kept: DataFrame) -> Mosaic:
    """The mosaic of the sets of ``kept`` (set) alone, from tiles: those with the same sets left are joined, those without any go."""
    left = mosaic.tile_sets.join(kept, "set", "left_semi")
    merged = build(left, "set", "tile")  # a tile of tiles, named by its least tile, which has its least object
    sizes = materialize(merged.objects.join(mosaic.tiles.select(F.col("tile").alias("obj"), "n"), "obj").groupBy("tile").agg(F.sum("n").alias("n")), "tiles")
    objects = mosaic.objects.join(merged.objects.select(F.col("obj").alias("tile"), F.col("tile").alias("to")), "tile").select("obj", F.col("to").alias("tile"))
    counts = merged.tile_sets.groupBy("set").agg(F.count("*").alias("n_tiles"))
    return Mosaic(sizes, merged.tile_sets, materialize(objects, "objects"), materialize(mosaic.sets.drop("n_tiles").join(counts, "set"), "sets"))
