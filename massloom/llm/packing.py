"""Hierarchical multi-length packing of token sequences.

Each document is tokenised once and routed by length to the smallest of several context-size tiers that
holds it; what is longer than the largest tier gives full windows and routes its rest.  Each tier is packed
by best fit, the gaps of long windows are filled with pieces of shorter tiers, and the windows of all partitions
are dealt to step groups of near-equal tokens: the windows of a tier in turn to the groups, so that groups differ by one window of each
tier at most.  A window whose length is one of the tiers is not padded.

Packing is local to a partition, in blocks of at most ``block_tokens`` tokens: no shuffle, memory bounded by
the block, and a lost task is redone alike.  Windows that a block leaves open are carried to the
next block, so a partition pads one window at most.

Defined cases: a null text is an empty text; an empty text is the end id alone; rows repeated are packed
each; no rows give no pieces; a very long text fills windows of its own and routes its rest.  Only id and text are read, so no
other column clashes.  Windows depend on how the input is split, not on timing; their ids are dense.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .rows import few, keyed_texts
from .tokens import default_vocabulary, encoder

TIERS = (128, 256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, tier long, in_tier long"


class Piece:
    """Part of a document: where it starts and ends there, and the document's number in the block."""

    __slots__ = ("doc", "start", "end")

    def __init__(self, doc: int, start: int, end: int) -> None:
        self.doc, self.start, self.end = doc, start, end

    def __len__(self) -> int:
        return self.end - self.start

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.start + n), Piece(self.doc, self.start + n, self.end)


def route(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """(full windows of the largest tier, pieces by tier)."""
    full, pools = [], [[] for _ in tiers]
    top = tiers[-1]
    for doc, n in enumerate(lengths):
        whole = n // top
        full += [[Piece(doc, k * top, (k + 1) * top)] for k in range(whole)]
        if rest := n - whole * top:
            pools[bisect_left(tiers, rest)].append(Piece(doc, whole * top, n))
    return full, pools


def pack_tier(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Best fit, longest first: (windows that are exactly full, windows with a gap)."""
    gaps: list[tuple[int, int]] = []  # (room, window), sorted
    windows: list[list[Piece]] = []
    for p in sorted(pieces, key=len, reverse=True):
        at = bisect_left(gaps, (len(p), -1))
        if at < len(gaps):
            room, w = gaps.pop(at)
        else:
            room, w = size, len(windows)
            windows.append([])
        windows[w].append(p)
        if room > len(p):
            insort(gaps, (room - len(p), w))
    unfilled = {w for _, w in gaps}
    return [x for w, x in enumerate(windows) if w not in unfilled], [windows[w] for _, w in gaps]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(windows with their tier, pieces left over).

    From the longest tier down: a gap takes pieces of the shorter tiers, longest first, the last one cut to
    fit; when those are used up, windows of the same tier are taken apart to fill the others.  What is left
    in the end is less than one window of the largest tier.  With ``last`` it is windowed too: power-of-two windows
    of the tiers, then one padded window.
    """
    full, pools = route(lengths, tiers)
    done = [(tiers[-1], w) for w in full]
    left: list[Piece] = []
    for k in range(len(tiers) - 1, -1, -1):
        filled, open_ = pack_tier(pools[k] + left, tiers[k]) if not left or max(map(len, left)) <= tiers[k] else pack_tier(_fit(pools[k] + left, tiers[k], done), tiers[k])
        done += [(tiers[k], w) for w in filled]
        left = []
        shorter = [p for pool in pools[:k] for p in sorted(pool, key=len)]  # from the end: longest first
        open_.sort(key=lambda w: sum(map(len, w)))  # from the end: the fullest
        spare: list[Piece] = []
        while open_:
            window = open_.pop()
            room = tiers[k] - sum(map(len, window))
            while room:
                if not spare:
                    if shorter:
                        spare.append(shorter.pop())
                    elif open_:
                        spare += open_.pop(0)
                    else:
                        break
                piece = spare.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                window.append(piece)
                room -= len(piece)
            if room:
                left += window
            else:
                done.append((tiers[k], window))
        left += spare
        if k:
            keep = {id(p) for p in shorter}
            for i in range(k):
                pools[i] = [p for p in pools[i] if id(p) in keep]
    if last and left:
        stream, rest = left, []
        for size in reversed(tiers):
            while sum(map(len, stream)) >= size:
                window, stream = _take(stream, size)
                done.append((size, window))
        if stream:
            done.append((tiers[-1], stream))
        left = rest
    return done, left


def _take(stream: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    window: list[Piece] = []
    stream = list(stream)
    while size:
        p = stream.pop(0)
        if len(p) > size:
            p, rest = p.cut(size)
            stream.insert(0, rest)
        window.append(p)
        size -= len(p)
    return window, stream


def _fit(pieces: list[Piece], size: int, done: list) -> list[Piece]:
    """Cuts full windows off pieces that are longer than ``size``."""
    out = []
    for p in pieces:
        while len(p) > size:
            head, p = p.cut(size)
            done.append((size, [head]))
        out.append(p)
    return out


def dealt(packed_: DataFrame, group_tokens: int) -> DataFrame:
    """Dense ids and step groups for the written pieces of ``packed``.

    A table of one row for each partition and tier says how many windows come before; a window's number in its tier,
    modulo the number of groups, is its group.  Each tier starts at the group where the one before it ended.
    """
    windows = packed_.where("offset = 0")
    counts = windows.groupBy("part", "tier").agg(F.count("*").alias("n"))
    upto = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(*by[-1])) - F.col("n")
    tiers = counts.withColumn("before_tier", upto(["tier", "part"])).select("part", "tier", F.col("before_tier"))
    parts = windows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before_part", upto(["part"])).select("part", "before_part")
    groups = max(1, round((packed_.agg(F.sum("length")).first()[0] or 0) / group_tokens))
    found = packed_.join(few(materialize(tiers.join(parts, "part"), "windows")), ["part", "tier"])
    number, group = F.col("before_part") + F.col("seq"), F.pmod(F.col("before_tier") + F.col("in_tier"), F.lit(groups))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset", "tier", group.alias("step_group"))


def packed(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, block_tokens: int = 4 << 20, group_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``start`` counts the document's ids before it, ``offset`` its place in the window.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_bytes
        part = TaskContext.get().partitionId()
        seq = 0
        in_tier = dict.fromkeys(tiers, 0)
        ids: list[bytes] = []
        names: list[int | None] = []
        base: list[int] = []  # ids of the document before what is in the block
        totals: list[int] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal seq, ids, names, base, totals, held
            windows, left = pack([len(x) // 4 for x in ids], tiers, last)
            rows = []
            for tier, window in windows:
                at = 0
                for p in window:
                    rows.append((names[p.doc], base[p.doc] + p.start, len(p), zlib.crc32(ids[p.doc][4 * p.start : 4 * p.end]), totals[p.doc], part, seq, at, tier, in_tier[tier]))
                    at += len(p)
                seq += 1
                in_tier[tier] += 1
            ids, names, base, totals = [ids[p.doc][4 * p.start : 4 * p.end] for p in left], [names[p.doc] for p in left], [base[p.doc] + p.start for p in left], [totals[p.doc] for p in left]
            held = sum(map(len, ids)) // 4
            made = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=columns)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = encode(text or "") + end
                names.append(name)
                ids.append(x)
                base.append(0)
                totals.append(len(x) // 4)
                held += len(x) // 4
                if held >= block_tokens:
                    yield flush(False)
        if ids:
            yield flush(True)

    return dealt(materialize(keyed_texts(docs, id_col, text_col).mapInArrow(run, SCHEMA), "pieces"), group_tokens)
