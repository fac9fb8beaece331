"""Mosaics against the raw members they are made of."""

import random
from collections import defaultdict

import pytest

from massloom.operators import mosaic, sets


@pytest.fixture(scope="module")
def members():
    r = random.Random(3)
    names = [f"s{k}" for k in range(7)]
    return [(s, o) for o in range(120) for s in r.sample(names, r.choice([0, 1, 1, 2, 3]))] + [("s0", 0), (None, 5), ("s1", None), ("big", 500)] + [("all", o) for o in range(120)]


@pytest.fixture(scope="module")
def built(spark, members):
    return mosaic.build(spark.createDataFrame(members, "set string, obj long").repartition(3), "set", "obj")


def signatures(members, kept=None):
    by = defaultdict(set)
    for s, o in members:
        if s is not None and o is not None and (kept is None or s in kept):
            by[o].add(s)
    tiles = defaultdict(list)
    for o, ss in by.items():
        tiles[frozenset(ss)].append(o)
    return {min(objs): (len(objs), ss) for ss, objs in tiles.items()}


def shape(m):
    n = {r["tile"]: r["n"] for r in m.tiles.collect()}
    ss = defaultdict(set)
    for r in m.tile_sets.collect():
        ss[r["tile"]].add(r["set"])
    return {t: (k, frozenset(ss[t])) for t, k in n.items()}


def test_tiles(built, members):
    want = signatures(members)
    assert shape(built) == want and built.total() == 121
    sizes = {r["set"]: (r["n_set"], r["n_tiles"]) for r in built.sets.collect()}
    assert sizes == {s: (sum(n for n, ss in want.values() if s in ss), sum(s in ss for _, ss in want.values())) for s in {s for s, _ in members if s}}
    assert built.objects.count() == 121


def test_weights(spark, built):
    got = {r["tile"]: r["weight"] for r in mosaic.tile_weights(built, spark.createDataFrame([(0, 2.0), (1, 0.5), (999, 7.0)], "obj long, weight double")).collect()}
    assert sum(got.values()) == 2.5 and len(got) == built.tiles.count()


def test_masked_by_tiles_and_by_members(spark, built, members):
    r = random.Random(4)
    masks = [(f"k{k}", o) for k in range(5) for o in r.sample(range(130), 30)] * 2 + [(None, 1), ("k0", None)]
    df = spark.createDataFrame(masks, "mask string, obj long")
    got = {(x["set"], x["mask"]): (x["nmasked"], x["nunmasked"], x["n_set"], x["n_mask"], x["log10_pvalue"]) for x in mosaic.mask_overlaps(built, df).collect()}
    of_set, of_mask = defaultdict(set), defaultdict(set)
    for s, o in members:
        if s is not None and o is not None:
            of_set[s].add(o)
    for k, o in masks:
        if k is not None and o in set().union(*of_set.values()):
            of_mask[k].add(o)
    want = {(s, k): len(a & b) for s, a in of_set.items() for k, b in of_mask.items() if a & b}
    assert {x: v[0] for x, v in got.items()} == want
    for (s, k), (n, rest, n_set, n_mask, p) in got.items():
        assert (rest, n_set, n_mask) == (len(of_set[s]) - n, len(of_set[s]), len(of_mask[k])) and p <= 0
    left, kept, low, high = mosaic.masked(built, df, max_sets=3, max_min_pvalue=0.9, min_nmasked=2)
    names = {x["set"] for x in kept.collect()}
    best = {s: min(v[4] for (t, _), v in got.items() if t == s and v[0] >= 2) for s in of_set if any(t == s and v[0] >= 2 for (t, _), v in got.items())}
    assert names == {s for s, p in best.items() if p <= low} and len(names) <= 3 and high == pytest.approx(low + (0 - sets.math.log10(0.9)))
    assert shape(left) == signatures(members, names)


def test_relevance(spark, built, members):
    df = spark.createDataFrame(members, "set string, obj long")
    marks = spark.createDataFrame([(o,) for o in range(0, 60)], "obj long")
    got = {r["set"]: r["relevance"] for r in mosaic.build(df, "set", "obj", reference=marks).sets.collect()}
    assert set(got) == {r["set"] for r in built.sets.collect()} and all(p <= 0 for p in got.values())


def test_empty(spark):
    m = mosaic.build(spark.createDataFrame([], "set string, obj long"), "set", "obj")
    assert m.tiles.collect() == [] and m.total() == 0 and mosaic.mask_overlaps(m, spark.createDataFrame([("k", 1)], "mask string, obj long")).collect() == []
