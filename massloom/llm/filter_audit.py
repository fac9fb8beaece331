"""Filter interaction audit: what each filter removes in each order of five, from 32 signed parity sums a part and label.

Every document has a mask of five bits, one for each filter that it fails.  For a set T of filters the parity sum is the
number of documents whose mask meets T in an even number of bits, less those that meet it in an odd one: the Walsh-Hadamard transform of
the 32 mask counts.  Sums add up, so they are made where the rows are and one row a task and part is shuffled; the transform is
its own inverse up to the factor 32, so whole mask counts come back exactly.  All 120 orders are then read from 32 cells
a part and label: a filter's step removes the cells that hold its bit and none of those before it, and its Shapley sum over all orders
is 120 / (failed filters) for each document that fails it, as each of a document's failed filters is the first in as many orders.

The fifth filter, a copy of a smaller id's text, needs other rows: narrow rows (digest, id, part, mask) are added up by digest before
a digest's least id is joined to them, so a text that a third of all rows share is one row for each part and label there.

Defined cases: a null text is an empty one, which fails A and, past the first, E; a null part is the empty string; a row without an
id copies nothing and no row copies it; rows that repeat one id and text are not copies of each other and each counts; a document
is good or toxic if any of its label rows says so, and one without an id has no labels.  An empty table gives no rows.
Texts are read whole.  Only id, text and part are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import few

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
#: Lists of 32 numbers that a part carries: all documents, good ones, toxic ones.
LABELS = ("n", "good", "toxic")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: Column) -> Column:
    """Bits of the four filters that look at one text alone: few words, few distinct words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << k).otherwise(0)
    return mask


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of labelled documents, one row each."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def mask_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by digest, part and labels, with all five bits in ``mask``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), own_mask(text).alias("mask"))
    rows = rows.join(few(materialize(label_flags(labels), "labels")), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # all rows of a digest have one mask; those of its least id, and those without an id, copy nothing
    each = rows.groupBy("digest", "mask", "part", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    groups = materialize(groups, "digests")
    lows = groups.groupBy("digest").agg(F.min("least.doc_id").alias("low"))
    first = F.coalesce(F.when(F.col("least.doc_id") == F.col("low"), F.col("least.n")), F.lit(0)) + F.col("no_id")
    found = groups.join(lows, "digest").select("part", "good", "toxic", "mask", "n", first.alias("first"))
    copies = F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
    kinds = F.array(F.struct("mask", F.col("first").alias("n")), copies)
    return found.select("part", "good", "toxic", F.explode(kinds).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 signed parity sums, added up on the map side."""
    aggregates = []
    for label in LABELS:
        n = F.col("n") if label == "n" else F.when(F.col(label), F.col("n")).otherwise(0)
        signed = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(t)) % 2 == 1, -n).otherwise(n)) for t in range(CELLS)]
        aggregates += [s.alias(f"{label}_{t}") for t, s in enumerate(signed)]
    sums = rows.groupBy("part").agg(*aggregates)
    return sums.select("part", *[F.array(*[f"{label}_{t}" for t in range(CELLS)]).alias(label) for label in LABELS])


def _sum(cells: Column, want: Callable[[Column], Column]) -> Column:
    """Sum over the cells whose mask is wanted."""
    picked = F.transform(cells, lambda c, m: F.when(want(m), c).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)


def mask_counts(sums: DataFrame) -> DataFrame:
    """The inverse transform: arrays of 32 counts by mask in place of the sums."""

    def inverse(s: Column) -> Column:
        def cell(m: Column) -> Column:
            terms = F.transform(s, lambda x, t: F.when(F.bit_count(m.bitwiseAND(t)) % 2 == 1, -x).otherwise(x))
            return F.shiftright(F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x), 5)

        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)

    return sums.select("part", *[inverse(F.col(label)).alias(label) for label in LABELS])


def evaluated(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    orders = list(map("".join, permutations(FILTERS)))
    steps = cells.select("*", F.explode(F.split(F.lit(" ".join(orders)), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    before = F.array_remove(F.split(F.expr("substring(filter_order, 1, step - 1)"), ""), "")
    steps = steps.withColumns({"own": bit(F.expr("substring(filter_order, step, 1)")), "before": F.aggregate(before, F.lit(0), lambda a, x: a + bit(x))})
    has, had = (lambda m: m.bitwiseAND(F.col("own")) > 0), (lambda m: m.bitwiseAND(F.col("before")) > 0)
    here = lambda m: has(m) & ~had(m)
    first_in = F.lit([0, *[len(orders) // k for k in range(1, len(FILTERS) + 1)]])  # orders in which one of k failed filters comes first
    shares = F.transform("n", lambda c, m: c * F.element_at(first_in, F.bit_count(m) + 1))
    return steps.select(
        "part", "filter_order", "step", _sum(F.col("n"), lambda m: ~has(m) & ~had(m)).alias("kept"), _sum(F.col("n"), here).alias("removed"), _sum(F.col("n"), lambda m: has(m) & had(m)).alias("redundant"),
        _sum(F.col("n"), lambda m: m == F.col("own")).alias("unique_fails"), _sum(F.col("good"), here).alias("good_lost"), _sum(F.col("toxic"), here).alias("toxic_lost"), _sum(shares, has).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) over all documents."""
    cells = materialize(mask_counts(parity_sums(mask_rows(docs, labels, **columns))), "cells")
    return evaluated(cells)
