"""Line dedup: repeated runs of lines, found in a suffix array over line-id sequences.

Lines are named by 128 bits of hashes of their trimmed text.  Suffixes of all documents are ranked by distributed prefix
doubling: ranks by the first h lines give ranks by the first 2h, and by any depth between.  A rank is the number of suffixes that
sort before its group, so the suffixes of one rank at depth d are an interval of the array: [rank, rank + group size), whose
neighbours all have a longest common prefix of d lines at least.  Suffixes that are alone at a depth leave, for no deeper
interval holds them.  The ranks of every depth up to the deepest that deletion asks for are kept; ``lcp_array`` reads the
array and its longest common prefixes (to that depth) off them.

Each interval of depth ``min_lines`` holds the places of one repeated run of lines; its first place (by document id, then line)
stays and the later copies are deleted.  With ``long_words`` so are those of shallower intervals whose run has more words than
that.  Deleted lines that touch make up the maximal runs.

Names and ranks are made by aggregations with map-side combine; a hot line is one row in those
tables, and the joins back to its places are between plain tables, which AQE splits.  Texts are shuffled once, to be cut.

Defined cases: a null text is one empty line; blank lines are lines, all equal; rows that repeat both id and text count as
one document and get the same result; null ids sort first; no rows give no rows; very long texts are cut at lines and read
whole.  A run that overlaps its own later copy (a line said over and over) keeps its first line at least.  Rows are boxed, so no
column clashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .rows import whole

#: Parts in which prefix sums are made, so that no window holds a hot group whole.
PARTS = 1024
DOC = ["doc_id", "doc_hash"]
PLACE = [*DOC, "line"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_hash, line, w, h1, h2); ``w`` is the number of words."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), F.posexplode(_lines(text)).alias("line", "s"))
    trimmed = F.btrim(F.col("s"), F.lit(" \t\n\x0b\x0c\r"))
    words = F.regexp_count("s", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select(*DOC, F.col("line").cast("long").alias("line"), words.alias("w"), F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit("second"), trimmed).alias("h2"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, line, w, rank) of the lines that occur more than once; rank by hash order."""
    names = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("part", F.shiftrightunsigned("h1", 54)), "names")
    totals = names.groupBy("part").agg(F.sum("n").alias("all"))  # at most PARTS rows
    start = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("start"))
    within = Window.partitionBy("part").orderBy("h1", "h2")
    ranked = names.join(F.broadcast(start), "part").select("h1", "h2", (F.col("start") + F.sum("n").over(within) - F.col("n")).alias("rank"))
    return lines.join(ranked, ["h1", "h2"]).select(*PLACE, "w", "rank")


def deeper(ranks: DataFrame, step: int, n: int) -> DataFrame:
    """Ranks by h + step lines from ``ranks`` by h lines (step at most h), of the suffixes that still repeat.

    ``n`` is above every rank.
    """
    ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(step, step)
    pairs = ranks.withColumn("second", F.first("rank").over(ahead)).where("second is not null")
    pairs = materialize(pairs.select(*PLACE, F.col("rank").alias("first"), "second"), "pairs")
    names = materialize(pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1").withColumn("part", F.floor(F.col("second") * PARTS / n).cast("int")), "names")
    totals = names.groupBy("first", "part").agg(F.sum("n").alias("all"))
    start = totals.select("first", "part", (F.sum("all").over(Window.partitionBy("first").orderBy("part")) - F.col("all")).alias("start"))
    within = Window.partitionBy("first", "part").orderBy("second")
    ranked = names.join(start, ["first", "part"]).select("first", "second", (F.col("first") + F.col("start") + F.sum("n").over(within) - F.col("n")).alias("rank"))
    return pairs.join(ranked, ["first", "second"]).select(*PLACE, "rank")


def ranks_by_depth(docs: DataFrame, depth: int, id_col: str = "doc_id", text_col: str = "text") -> dict[int, DataFrame]:
    """For each depth up to ``depth``: (doc_id, doc_hash, line, rank) of the suffixes whose first so many lines occur elsewhere too."""
    lines = line_ids(docs, id_col, text_col)
    made = {1: materialize(first_ranks(lines), "ranks")}
    n = max(1, made[1].count())
    for d in range(2, depth + 1):
        half = 1 << ((d - 1).bit_length() - 1)  # the deepest power of two before d
        made[d] = materialize(deeper(made[half], d - half, n), "ranks")
    return made


def lcp_array(ranks: dict[int, DataFrame]) -> DataFrame:
    """(doc_id, doc_hash, line, position, lcp): the array of repeated suffixes; ``lcp`` with the suffix before, to the depth of ``ranks``.

    Suffixes that no depth holds together any more are in order of their places.
    """
    rows = ranks[1].select(*PLACE, F.col("rank").alias("r1"))
    for d in sorted(ranks)[1:]:
        rows = _met(rows, ranks[d], f"r{d}")
    keys = [f"r{d}" for d in sorted(ranks)]
    # one interval of depth 1 after the other; the suffixes of each by their deeper ranks
    order = Window.partitionBy("r1").orderBy(*[F.col(k).asc_nulls_last() for k in keys[1:]], *PLACE)
    before = [F.lag(k).over(order).alias(f"_{k}") for k in keys]
    rows = rows.select("*", (F.row_number().over(order) - 1 + F.col("r1")).alias("position"), *before)
    lcp, same = F.lit(0), F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
        lcp = lcp + F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0)
    return rows.select(*PLACE, "position", lcp.alias("lcp"))


def _met(rows: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """``rows`` with the rank of each place in ``ranks`` as ``name``, null where it has none; ids may be null."""
    other = ranks.select(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h"), F.col("line").alias("_l"), F.col("rank").alias(name))
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")) & (F.col("line") == F.col("_l")), "left").drop("_i", "_h", "_l")


def later_copies(ranks: DataFrame) -> DataFrame:
    """The places of each interval but its first."""
    place = F.struct(*PLACE)
    first = materialize(ranks.groupBy("rank").agg(F.min(place).alias("kept")), "first")
    return materialize(ranks.join(first, "rank").where(place > F.col("kept")).select(*PLACE), "later")


def long_runs(ranks: dict[int, DataFrame], later: DataFrame, depth: int, long_words: int) -> DataFrame:
    """Those of ``later`` whose run of ``depth`` lines has more than ``long_words`` words."""
    ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(0, depth - 1)
    once = F.row_number().over(Window.partitionBy(*PLACE).orderBy("line")) == 1  # documents that repeat count once
    lines = ranks[1].select(*PLACE, F.when(once, F.col("w")).otherwise(0).alias("w"))
    words = lines.select(*PLACE, F.sum("w").over(ahead).alias("rank")).where(F.col("rank") > long_words)  # every line of the run repeats
    return _met(later, words.distinct(), "words").where("words is not null").select(*PLACE)


def runs_of(gone: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, runs): maximal runs, as [first, last], of the lines (doc_id, doc_hash, line)."""
    starts = gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("s"))
    opens = F.expr("filter(s, (x, i) -> i = 0 or x > s[i - 1] + 1)")
    closes = F.expr("filter(s, (x, i) -> i = size(s) - 1 or s[i + 1] > x + 1)")
    return starts.select(*DOC, F.arrays_zip(opens.alias("first"), closes.alias("last")).alias("runs"))


def line_dedup(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = 50) -> DataFrame:
    """doc (struct of the row's columns), doc_id, clean_text, n_lines, removed_runs (array of first and last line, from 0).

    Later copies of runs of ``min_lines`` lines go, and of shorter runs that have more words than ``long_words`` (None: none).
    """
    ranks = ranks_by_depth(docs, min_lines, id_col, text_col)
    gone = []
    for d in range(min_lines if long_words is None else 1, min_lines + 1):
        later = later_copies(ranks[d])
        later = later if d == min_lines else long_runs(ranks, later, d, long_words)
        gone.append(later.select(*DOC, F.explode(F.sequence("line", F.col("line") + (d - 1))).alias("line")))
    runs = runs_of(reduce(DataFrame.unionByName, gone)).select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "runs")
    own = docs.select(whole(docs).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_own"), F.col(text_col).alias("_text"))
    joined = own.join(runs, own["doc_id"].eqNullSafe(runs["_id"]) & (own["_own"] == runs["_hash"]), "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    joined = joined.withColumn("_lines", _lines(F.col("_text"))).withColumn("_runs", F.coalesce("runs", none))
    # what stays lies before the first run, between runs, and after the last
    kept = F.expr(
        "flatten(transform(sequence(0, size(_runs)), i -> slice(_lines, cast(if(i = 0, 0, _runs[i - 1].last + 1) + 1 as int), "
        "cast(if(i = size(_runs), size(_lines), _runs[i].first) - if(i = 0, 0, _runs[i - 1].last + 1) as int))))"
    )
    return joined.select("doc", "doc_id", F.array_join(kept, "\n").alias("clean_text"), F.size("_lines").cast("long").alias("n_lines"), F.col("_runs").alias("removed_runs"))
