"""Spelling variants: words at one inserted, deleted or replaced code point, by two-dimensional range reporting.

Words that are alike but for an edit at place i share the i code points before it and all that follow.  In forward order the
words with that beginning are an interval, in the order of the reversed words those with that end are one, and the near words
are the points of the rectangle of both.  A wavelet tree over reverse ranks in forward order reports them in time for what it finds.

One tree over all words would have to lie in one task, so words are dealt to blocks.  An edit lies in the first half of a
word or in the second, and what is outside of that half is shared: a block holds the words of one length (replacements), or of two
(insertions), that agree outside of one segment, and its rectangles are the segment's places.  A word is in six blocks.  A block
whose cells (words times places) are too many for a task is parted by the halves of its segment, again and again down to single
places, where a block has no more words than there are letters; nothing is dropped, and each near pair is found at one place of
one block: a replacement at the place where both differ, an insertion at the first of the places that give it.  Tasks return
counts and the best near word of each word, not pairs.

Forms at least double the count, so chains of them are short; roots are found by doubling the steps, in as many rounds as the
logarithm of the longest chain.

Defined cases: a null text has no words; a null id counts as an empty one in the checksum; rows that repeat count again; an empty table
gives no rows.  Texts are read whole, words of any length are words.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .rows import keyed_texts, whole_groups

#: Maximal runs of letters of the first two blocks.
RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words times places that one block may have; rows that a task searches at once; rectangles that are answered at once.
BLOCK_CELLS, SEARCH_ROWS, RECTANGLES = 1 << 17, 1 << 14, 1 << 15
REPLACE, INSERT = 0, 1


def lowered(run: Column) -> Column:
    """A-Z alone in lower case; ``lower`` does the same, and faster, where there is no other capital."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 5, least_n: int = 3, damage: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of at least ``least_points`` code points with ``least_n`` occurrences.

    Where ``damage`` divides the checksum of ``<doc_id>:<run>``, the run has lost a code point, as in a noisy copy.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.expr("CAST(h % length(run) AS INT)")
    less = F.concat(F.expr("substring(run, 1, CAST(h % length(run) AS INT))"), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_points)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their block: kind, base length, segment and what is shared outside of it."""
    head, tail = F.expr("substring(word, 1, a)"), F.expr("substring(word, b + 1 + longer, length(word))")
    return rows.withColumn("key", F.concat(F.concat_ws(",", "kind", "base", "a", "b"), F.lit(":"), head, tail))


def seeds(words: DataFrame) -> DataFrame:
    """(word, n, kind, base, a, b, longer, key): the blocks of each word, by the halves of the shorter word of a pair.

    ``longer`` is 1 for the word of an insertion that has one code point more than ``base``.
    """
    n = F.length("word")

    def halves(kind: int, base: Column, longer: int) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        parts = ((F.lit(0), half), (half, base))
        return [F.struct(F.lit(kind).alias("kind"), base.alias("base"), a.alias("a"), b.alias("b"), F.lit(longer).alias("longer")) for a, b in parts]

    rows = F.array(*halves(REPLACE, n, 0), *halves(INSERT, n, 0), *halves(INSERT, n - 1, 1))
    rows = F.array_distinct(F.filter(rows, lambda x: (x["a"] < x["b"]) | (x["base"] == 0)))  # a half of nothing has no places
    return keyed(words.select("word", "n", F.explode(rows).alias("x")).select("word", "n", "x.*"))


def halved(rows: DataFrame) -> DataFrame:
    """The same rows in blocks of half the segment."""
    mid = F.expr("CAST((a + b) DIV 2 AS INT)")
    parts = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
    return keyed(rows.select("word", "n", "kind", "base", "longer", F.explode(parts).alias("x")).select("word", "n", "kind", "base", "x.a", "x.b", "longer"))


def blocks(words: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """Rows of blocks that fit a task each; a block that does not is parted."""
    live, done = seeds(words), []
    while True:
        sizes = live.groupBy("key").agg(F.count("*").alias("rows"), F.first("a").alias("a"), F.first("b").alias("b"))
        large = materialize(sizes.where((F.col("b") - F.col("a") > 1) & (F.col("rows") * (F.col("b") - F.col("a") + 1) > cells)).select("key"), "large")
        if large.isEmpty():
            break
        done.append(live.join(large, "key", "left_anti"))
        live = materialize(halved(live.join(large, "key", "left_semi")), "blocks")
    for d in done:
        live = live.unionByName(d)
    return live


def wavelet(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Levels of a wavelet tree over ``values``, from the highest bit: how many zeros stand before each place."""
    levels = []
    for k in reversed(range(bits)):
        one = (values >> k & 1).astype(bool)
        levels.append(np.concatenate([[0], np.cumsum(~one)]))
        values = np.concatenate([values[~one], values[one]])
    return levels


def report(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rectangle, value): distinct values from ``least`` to below ``most`` at places from ``lo`` to below ``hi``, for all rectangles at once."""
    rect, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
    for k, zeros in zip(reversed(range(len(levels))), levels, strict=True):
        half, l0, h0 = 1 << k, zeros[lo], zeros[hi]
        l1, h1 = zeros[-1] + lo - l0, zeros[-1] + hi - h0
        to0 = (h0 > l0) & (value < most[rect]) & (value + half > least[rect])
        to1 = (h1 > l1) & (value + half < most[rect]) & (value + 2 * half > least[rect])
        rect = np.concatenate([rect[to0], rect[to1]])
        value = np.concatenate([value[to0], value[to1] + half])
        lo, hi = np.concatenate([l0[to0], l1[to1]]), np.concatenate([h0[to0], h1[to1]])
    return rect, value


def intervals(block: np.ndarray, letters: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, lo, hi): a row's place in the order of its letters within its block, and for each length the interval, in ranks of
    points, of the rows that begin alike.  ``lo`` and ``hi`` are indexed by length and row."""
    rows, width = letters.shape
    order = np.lexsort([*letters.T[::-1], block])
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    x, g = letters[order], block[order]
    differs = np.ones((rows - 1, width + 1), bool)
    differs[:, :width] = x[1:] != x[:-1]
    alike = np.where(g[1:] == g[:-1], differs.argmax(1), -1)
    before = np.concatenate([[0], np.cumsum(point[order])])
    lo, hi = np.empty((width + 1, rows), np.int64), np.empty((width + 1, rows), np.int64)
    at = np.arange(rows)
    for length in range(width + 1):
        new = np.concatenate([[True], alike < length])
        start = np.maximum.accumulate(np.where(new, at, 0))
        end = np.minimum.accumulate(np.where(np.concatenate([new[1:], [True]]), at + 1, rows)[::-1])[::-1]
        lo[length, order], hi[length, order] = before[start], before[end]
    return rank, lo, hi


def search(block: np.ndarray, words: list[str], n: np.ndarray, kind: np.ndarray, base: np.ndarray, a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, best, found): how many near words each row has in its block, and the row of the most frequent of them, -1 without any."""
    rows = len(words)
    middles = [w[s : e + more] for w, s, e, more in zip(words, a.tolist(), b.tolist(), longer.tolist(), strict=True)]
    width = int((b - a + longer).max())
    letters = np.array(middles, f"<U{width}").view("<u4").reshape(rows, width)
    last = np.array([w[s - 1] if s else "" for w, s in zip(words, a.tolist(), strict=True)], "<U1").view("<u4")
    size = b - a + longer
    turned = np.where(np.arange(width) < size[:, None], np.take_along_axis(letters, np.maximum(size[:, None] - 1 - np.arange(width), 0), 1), 0)
    replace = kind == REPLACE
    point, asks = replace | (longer == 1), replace | (longer == 0)
    rank, plo, phi = intervals(block, letters, point)
    back, slo, shi = intervals(block, turned, point)
    points = np.flatnonzero(point)
    forward = points[np.argsort(rank[points])]
    by_end = points[np.argsort(back[points])]
    place = np.empty(rows, np.int64)
    place[by_end] = np.arange(len(points))
    levels = wavelet(place[forward], max(1, int(len(points) - 1).bit_length()))
    near, best = np.zeros(rows, np.int64), np.full(rows, -1)

    def count(target: np.ndarray, other: np.ndarray) -> None:
        near[:] += np.bincount(target, minlength=rows)
        held = np.flatnonzero(best >= 0)
        target, other = np.concatenate([target, held]), np.concatenate([other, best[held]])
        # within a block, words near to one word have one length, and so the order of their letters here
        order = np.lexsort([rank[other], -n[other], target])
        first = order[np.concatenate([[True], target[order][1:] != target[order][:-1]])] if len(order) else order
        best[target[first]] = other[first]

    for step in range(width):
        own = asks & (step < b - a + (~replace & (b == base)))
        row = np.flatnonzero(own)
        rest = (b - a)[row] - step - replace[row]
        rect = np.stack([plo[step, row], phi[step, row], slo[rest, row], shi[rest, row]])
        some = (rect[1] - rect[0] > replace[row]) & (rect[3] - rect[2] > replace[row])  # a replacement's rectangle holds the word itself
        row, rect = row[some], rect[:, some]
        for at in range(0, len(row), RECTANGLES):
            part = slice(at, at + RECTANGLES)
            which, value = report(levels, *rect[:, part])
            q, p = row[part][which], by_end[value]
            inserted = letters[p, step]
            previous = letters[p, step - 1] if step else last[p]
            keep = np.where(replace[q], q != p, inserted != previous)
            q, p = q[keep], p[keep]
            count(q, p)
            other_way = ~replace[q]  # a replacement is found from both words
            count(p[other_way], q[other_way])
    return near, best, np.flatnonzero(near)


def near_words(words: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """(word, n_near, best_n, best) of those of ``words`` (word, n; distinct) that have near words."""
    ship_package(words.sparkSession)
    dealt = blocks(words, cells).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", SEARCH_ROWS):
            key = t["key"].to_numpy()
            block = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            cols = {c: t[c].to_numpy() for c in ("n", "kind", "base", "a", "b", "longer")}
            # blocks with one side alone have no pairs
            point, asks = np.bincount(block, (cols["kind"] == REPLACE) | (cols["longer"] == 1)), np.bincount(block, (cols["kind"] == REPLACE) | (cols["longer"] == 0))
            several = ((point > 0) & (asks > 0) & (np.bincount(block) > 1))[block]
            if not several.any():
                continue
            words_of = t["word"].to_numpy()
            # rows of about one width are searched together, so that a few long words do not widen all
            wide = np.ceil(np.log2(cols["b"] - cols["a"] + 1)).astype(int)
            for w in np.unique(wide[several]):
                own = np.flatnonzero(several & (wide == w))
                near, best, found = search(block[own], words_of[own].tolist(), *(cols[c][own] for c in ("n", "kind", "base", "a", "b", "longer")))
                if len(found):
                    to = own[best[found]]
                    yield pa.RecordBatch.from_arrays([pa.array(words_of[own[found]], pa.string()), pa.array(near[found]), pa.array(cols["n"][to]), pa.array(words_of[to], pa.string())], names=["word", "n_near", "best_n", "best"])

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), "x.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: the last form of each chain, by doubling."""
    up = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_up = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(up.join(next_up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        up = new.select("word", "root")
        if new.where("moved").isEmpty():
            return up


def spelling_variants(words: DataFrame, times: int = 2, cells: int = BLOCK_CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n).

    A word's form is its near word of largest n (ties: least in code-point order), if that is at least ``times`` its own.
    """
    words = materialize(words, "words")
    joined = words.join(near_words(words, cells), "word", "left")
    formed = F.col("best_n") >= times * F.col("n")
    rows = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    up = roots(rows.where("form is not null"))
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
