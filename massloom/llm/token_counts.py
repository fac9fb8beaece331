"""Token counts: a two-tier lookup of pre-token lengths inside of each task.

A pre-token is a maximal run without ASCII white space.  The vocabulary's normaliser and splitter drop white space and never
join what it parts, so a text has as many tokens as its pre-tokens have one by one.  Their lengths come from

1. a compact table of frequent pre-tokens: two Arrow columns of at most ``TABLE`` rows, counted in a bounded sample, encoded
   once on the driver and broadcast, which is looked up by hash for a whole batch at a time;
2. for what is not in it, a cache of bounded size in each Python worker, filled by the library itself.

Nothing is shuffled: pre-tokens stay where they are read.  The sample only decides what is found fast: any table, an empty one
too, gives the same counts.  It reads up to ``SAMPLE_BYTES`` of some partitions (all of the first ``SAMPLED``, then one of more
and more, so a million partitions send some hundred summaries of at most ``SUMMARY`` pre-tokens each).

Defined cases: a null text is an empty one and has no token; rows that repeat or lack an id are rows like others; an empty table
gives no rows.  Long texts are counted whole, cut at white space into pieces of about ``PIECE`` bytes; one pre-token is
encoded in one go, however long.  Strings of special tokens inside a text are what the library's default makes of them.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

try:
    import public_tokenizers
except ImportError:  # the vocabulary's path is a parameter; this is only where it defaults to
    public_tokenizers = None

from ..session import ship_package
from .rows import keyed_texts

#: Rows of the broadcast table, and bytes of a pre-token that a table or cache may hold: 2 MB at most.
TABLE, LONGEST = 1 << 15, 64
#: Partitions that are all sampled, bytes of text read in each, pre-tokens that one tells.
SAMPLED, SAMPLE_BYTES, SUMMARY = 16, 1 << 20, 4096
#: Pre-tokens that a worker remembers, about, and bytes of text that it splits at once.
CACHE, PIECE = 1 << 20, 4 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Lengths:
    """Token counts of pre-tokens by the library; short ones are remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt the work
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_truncation()
        self.inner.no_padding()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def encoded(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(words), 4096):
            out += [len(e) for e in self.inner.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """Counts of distinct ``words``.

        What is remembered is of two ages: once the younger is full it becomes the older, which goes.
        """
        held = [self.known.get(w) or self.older.get(w) for w in words]
        new = [w for w, n in zip(words, held, strict=True) if n is None]
        fresh = iter(self.encoded(new))
        got = [next(fresh) if n is None else n for n in held]
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        self.known.update((w, n) for w, n in zip(words[:CACHE], got, strict=False) if n and len(w) <= LONGEST)
        return np.array(got, np.int64)


_lengths: dict[str, Lengths] = {}


def lengths(path: str) -> Lengths:
    """One cache for each worker process and vocabulary."""
    if path not in _lengths:
        _lengths[path] = Lengths(path)
    return _lengths[path]


def pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, texts): runs of rows of about ``size`` bytes; a longer text comes in pieces that end at white space."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        if stop > at + 1 or ends[at] - before <= size:
            yield at, stop - at, texts.slice(at, stop - at)
        else:
            raw = texts[at].as_buffer()
            start = 0
            while start < len(raw):
                cut = BLANK.search(raw, min(start + size, len(raw)))
                end = cut.start() if cut else len(raw)
                yield at, 1, pa.array([raw[start:end].to_pybytes()], pa.binary()).cast(pa.string())
                start = end
        at = stop


def split(texts: pa.Array) -> pa.ListArray:
    """Pre-tokens of each text; there may be empty strings at its ends."""
    return pc.ascii_split_whitespace(texts)


def counted(texts: pa.Array, table: pa.Table, by: Lengths, size: int = PIECE) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    for first, rows, part in pieces(texts, size):
        words = split(part)
        flat = words.flatten()
        place = pc.index_in(flat, value_set=table["word"])
        n = np.zeros(len(flat), np.int64)
        missing = place.is_null().to_numpy(zero_copy_only=False)
        n[~missing] = table["n"].to_numpy()[place.drop_null().to_numpy()]
        if missing.any():
            rest = flat.filter(pa.array(missing)).dictionary_encode()
            n[missing] = by.of(rest.dictionary.to_pylist())[rest.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(n)])
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        out[first : first + rows] += sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def takes_part(partition: int) -> bool:
    """All of the first partitions, then the n-th with a chance of ``SAMPLED`` in n, by its hash."""
    return partition < SAMPLED or zlib.crc32(b"%d" % partition) * partition < SAMPLED << 32


def frequent(texts: DataFrame, path: str, rows: int = TABLE) -> pa.Table:
    """(word, n): the most frequent pre-tokens of the sample, most frequent first, with their token counts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not takes_part(TaskContext.get().partitionId()):
            return
        left, seen = SAMPLE_BYTES, Counter()
        for b in batches:
            for _, _, part in pieces(b["text"].fill_null(""), SAMPLE_BYTES):
                left -= int(pc.sum(pc.binary_length(part)).as_py() or 0)
                for x in pc.value_counts(split(part).flatten()):
                    w = x["values"].as_py()
                    if 0 < len(w.encode()) <= LONGEST:
                        seen[w] += x["counts"].as_py()
                if left <= 0:
                    break
            if left <= 0:
                break
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]]), pa.array([[n for _, n in top]])], names=["words", "counts"])

    total: Counter[str] = Counter()
    for r in texts.mapInArrow(summary, "words array<string>, counts array<long>").collect():
        total.update(dict(zip(r["words"], r["counts"], strict=True)))
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:rows]]
    return pa.table({"word": pa.array(["", *words]), "n": pa.array([0, *lengths(path).encoded(words)], pa.int64())})


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, table_rows: int = TABLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document by the tokenizer file at ``path``.

    The file must split texts at ASCII white space, as those with word ends do; ``check_vocabulary`` tells.
    """
    path = path or default_vocabulary()
    check_vocabulary(path)
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(texts.select("text"), path, table_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = lengths(path)
        for b in batches:
            text = b["text"].fill_null("")
            n = counted(text, shared.value, by)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def check_vocabulary(path: str) -> None:
    """An error for a tokenizer in whose eyes white space matters: it would count other tokens for a text than for its parts."""
    by = lengths(path)
    probes = ["it's", "a b", " a\t\nb\u000bc\fd\re ", "don 't x1 2y", "é́ ́e", "<|x|> y"]
    if any(by.encoded([t])[0] != sum(by.encoded(re.split("[\x20\x09-\x0d]+", t))) for t in probes):
        raise ValueError(f"{path}: its tokens depend on white space")
