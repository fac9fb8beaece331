"""Scalar and list functions on hand-made values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from massloom.functions import lists, nulls, stats, strings


def column(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_expand(spark):
    df = spark.createDataFrame([(1, "a;b"), (2, None), (3, "c;")], "k int, xs string")
    assert sorted(map(tuple, lists.expand_delim_column(df, "xs", "k").collect()), key=str) == [(1, "a"), (1, "b"), (2, None), (3, ""), (3, "c")]
    with pytest.raises(ValueError):
        lists.expand_delim_column(df, "k", "xs")
    assert lists.expand_delim_column(df.select("k", F.lit("a.b").alias("xs")), "xs", "k", delim=".").count() == 6


def test_tokens(spark):
    df = spark.createDataFrame([("b;a",), (None,), ("a;c",)], "s string")
    assert df.agg(lists.rejoin_unique_tokens(F.col("s")), lists.rejoin_unique_tokens(F.col("s"), ";", "|"), lists.unique_tokens(F.col("s"))).first()[:] == ("a;b;c", "a|b|c", ["a", "b", "c"])
    assert column(spark, lists.n_matches(F.col("s"), "a+"), [("aabaa",), ("x",), (None,)], "s string") == [2, 0, None]


def test_nulls(spark):
    assert column(spark, nulls.zero_to_null(F.col("x")), [(0.0,), (-1.0,), (5.0,), (None,)], "x double") == [None, None, 5.0, None]
    assert column(spark, nulls.flag(F.col("x")), [("+",), ("True",), ("",), ("False",), (None,)], "x string") == [True, True, False, False, None]
    assert column(spark, nulls.extract_or_null(F.col("x"), "a(b)?", 1), [("ab",), ("a",), ("z",), (None,)], "x string") == ["b", None, None, None]
    assert column(spark, nulls.null_tokens(F.col("x"), ["", "NA"]), [("NA",), ("",), ("q",)], "x string") == [None, None, "q"]
    df = spark.createDataFrame([(1,), (None,)], "k int")
    with pytest.raises(Exception, match="null in key"):
        nulls.assert_no_null_keys(df, ["k"]).collect()
    assert [r[0] for r in nulls.fill_flags(spark.createDataFrame([(None,), (True,)], "b boolean")).collect()] == [False, True]


def test_identifiers(spark):
    assert column(spark, strings.strip_isoform(F.col("a")), [("P12345-2",), ("P12345-PRO_12",), ("P1",)], "a string") == ["P12345", "P12345", "P1"]
    rank = strings.rank_accession(F.col("a"), F.col("g"), F.col("d"), F.col("e"))
    assert column(spark, rank, [("P12345-2", None, "tr", None), ("P1", "G", "sp", 1)], "a string, g string, d string, e int") == [20, 0]
    assert column(spark, strings.fix_annotation_source(F.col("s")), [("gobp",), ("REACTOME x",), ("other",)], "s string") == ["GO_BP", "Reactome", "other"]
    assert column(spark, strings.flanking_sequence(F.col("s"), F.lit(2), 3), [("abcdef",)], "s string") == ["__ABCDE"]
    label = strings.ptm_label(F.lit("Phospho"), F.col("g"), F.lit("S"), F.lit(5), F.col("x"))
    assert column(spark, label, [(7, None), (None, 2)], "g int, x int") == ["Phospho_7_S5", "Phospho_Unknown-2_S5"]
    with pytest.raises(ValueError):
        strings.ptm_pattern("x")
    assert column(spark, strings.parse_locprob(F.col("s"), "spectronaut"), [("_A[Phospho (S): 98.0%]K_",)], "s string") == [0.98]


def test_labels(spark):
    assert column(spark, strings.escape_arrows(F.col("s")), [("a<->b",)], "s string") == ["a&lt;-&gt;b"]
    assert column(spark, strings.stylize_contrast(F.col("s"), {"a": "<b>a</b>"}), [("a_vs_c+",), ("x",)], "s string") == ["<b>a</b> vs c+", "x"]
    assert column(spark, strings.plain_label(F.col("s")), [("<b>a</b><br>c",)], "s string") == ["ac"]
    assert column(spark, strings.label_lines(F.col("s")), [("a<br>\nb\nc",)], "s string") == [["a", "b", "c"]]
    flows = strings.flow_label(F.col("v"), F.col("n"))
    assert column(spark, flows, [([2, 1, 2], ["b", "a", "b"])], "v array<int>, n array<string>") == ["a(1) b(2)"]
    assert column(spark, strings.replace_chain(F.col("s"), [("a", "b"), ("b", "c")]), [("ab",)], "s string") == ["cc"]
    df = spark.createDataFrame([(1, None, "q"), (2, None, "q"), (3, "z", None)], "id int, x string, y string")
    got = {r["id"]: (r["label"], r["tooltip"]) for r in strings.axis_labels(df, "id", ["x", "y"], tooltip_cols=["x", "y"]).collect()}
    assert got == {1: ("q (1)", "y: q"), 2: ("q (2)", "y: q"), 3: ("z", "x: z")}


def test_collapse(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "c"), (1, 3, None), (2, 1, None)], "k int, o int, v string")
    assert {r[0]: r[1] for r in df.groupBy("k").agg(strings.collapse_values(F.col("v"), F.col("o"))).collect()} == {1: "c; b", 2: None}


def test_hypergeometric(spark):
    rows = [(k, n, m, t) for t in (20, 300) for m in (3, t // 2) for n in (4, t // 3) for k in range(0, min(n, m) + 1, max(1, min(n, m) // 4))]
    got = column(spark, stats.hypergeom_log10_sf(*[F.col(c) for c in "knmt"]), rows, "k long, n long, m long, t long")
    for (k, n, m, t), g in zip(rows, got, strict=True):
        want = sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(t, n)
        assert g == pytest.approx(math.log10(want), abs=1e-9)


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 2.0), ("b", 5.0, 1.0), ("b", 7.0, 0.0), ("c", None, 1.0)], "k string, v double, w double")
    got = {r[0]: r[1] for r in stats.weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {"a": pytest.approx(2 + 2 / 3), "b": 5.0}


def test_grid(spark):
    df = spark.createDataFrame([(float(2**k),) for k in range(11)], "v double")
    grid = stats.quantile_grid(df, "v", quantile_range=1.0, bins=11)
    assert grid == [2.0**k for k in range(11)]
    assert [r[0] for r in df.select(stats.grid_bin(F.col("v"), grid)).collect()] == list(range(1, 12))
    assert stats.quantile_grid(df.limit(0), "v") == []


def test_lambert():
    for x in (-0.36, -0.2, -1e-3, -1e-8):
        w = stats.lambert_w_minus(x)
        assert w <= -1 and w * math.exp(w) == pytest.approx(x, rel=1e-10)
    with pytest.raises(ValueError):
        stats.lambert_w_minus(0.1)


def brute_median(rows):
    """Value at half of the weight between midpoints, rows in order of value and weight."""
    rows = sorted((v, w) for v, w in rows if w and w > 0 and v is not None)
    half, upto, last = sum(w for _, w in rows) / 2, 0.0, None
    for v, w in rows:
        mid = upto + w / 2
        if mid >= half - 1e-12:
            return v if last is None or mid - half < 1e-12 else last[0] + (half - last[1]) / (mid - last[1]) * (v - last[0])
        upto, last = upto + w, (v, mid)
    return last and last[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_medians_and_ranks_by_ranges(spark, parts):
    """A key with most rows, a value with a third of them, equal rows, null keys: spread over ranges, and the same as in order."""
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "hot", "b", None]), r.choice([0.0, 0.0, round(r.gauss(0, 3), 1)]), r.choice([0.0, 0.25, 0.5, r.random(), None]), k) for k in range(3000)] + [("one", 5.0, 2.0, 9000), ("none", 1.0, 0.0, 9001)]
    df = spark.createDataFrame(rows, "k string, v double, w double, id long").repartition(3)
    got = {x["k"]: x["m"] for x in stats.weighted_median(df, ["k"], "v", "w", "m", parts).collect()}
    want = {k: brute_median([(v, w) for q, v, w, _ in rows if q == k]) for k in {"hot", "b", None, "one"}}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    ranks = {x["id"]: (x["rank"], x["qtl"]) for x in stats.ranked(df, ["k"], ["v", "id"], "rank", "qtl", parts).collect()}
    for k in {q for q, *_ in rows}:
        own = sorted((v, i) for q, v, _, i in rows if q == k)
        assert all(ranks[i] == (at, pytest.approx(at / len(own))) for at, (_, i) in enumerate(own, 1))
    assert stats.weighted_median(df, [], "v", "w", "m", parts).first()["m"] == pytest.approx(brute_median([(v, w) for _, v, w, _ in rows]), abs=1e-9)
    assert stats.ranked(df.limit(0), ["k"], ["v"]).collect() == [] and stats.weighted_median(df.limit(0), ["k"], "v", "w").collect() == []


def test_ranges_of_a_hot_run_are_even(spark):
    df = spark.range(200_000).select(F.lit("run").alias("k"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(1)).alias("v"), "id")
    sizes = [r["n"] for r in stats._spread(df, ["k"], [F.col("v"), F.col("id")], 16).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 200_000 / 16


@pytest.mark.parametrize("parts", [1, 6])
def test_exact_quantiles(spark, parts):
    import numpy as np

    r = random.Random(8)
    values = [r.choice([0.0, 1.5, r.gauss(0, 9)]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    assert stats.exact_quantiles(df, "v", shares, parts) == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    assert stats.exact_quantiles(df.limit(0), "v", shares, parts) == [] and stats.exact_quantiles(df.where("v = 1.5"), "v", [0.5], parts) == [1.5]


@pytest.mark.parametrize("parts", [1, 5])
def test_skyline(spark, parts):
    r = random.Random(2)
    points = [(k, r.choice([None, float("nan"), *map(float, range(9))]), r.choice([None, *range(9)])) for k in range(200)]
    df = spark.createDataFrame(points, "k int, a double, b int")
    fine = [(k, a, b) for k, a, b in points if a is not None and a == a and b is not None]
    want = {k for k, a, b in fine if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in fine)}
    got = [x["k"] for x in stats.skyline(df, "a", "b", parts).collect()]
    assert set(got) == want and len(got) == len(want) and stats.skyline(df.limit(0), "a", "b", parts).collect() == []
