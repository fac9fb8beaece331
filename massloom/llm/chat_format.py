"""Chat formatting by token-level assembly.

Every segment (role, text) is encoded by itself and reserved ids, which no text can produce, are spliced
between: TURN role-ids BODY text-ids END.  The loss mask is the prefix sum of +1 where an assistant's text
starts and -1 where it ends.  Control strings that occur in a text are escaped reversibly: each gets one
backslash more than twice the backslashes before it.

Defined cases: a null text or role is empty; rows of one turn follow by role and text; an empty
assistant text has no token under the mask; no rows give no conversations.  Rows that repeat are turns each.  Only conv_id, turn,
role and text are read, so no other column clashes.  A conversation is assembled whole, as a model reads it: it must fit a row (2 GB) and a
task; conversations are spread over tasks by their id.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .rows import map_batches
from .tokens import default_vocabulary, encoder

#: Reserved ids follow the vocabulary's 50,257, and what each reads as.
TURN, BODY, END = 50257, 50258, 50259
READS = {TURN: "### ", BODY: ": ", END: " </turn>\n"}
#: What a text must not contain unescaped.
CONTROL = re.compile(r"(\\*)(###|</turn>)")
ESCAPED = re.compile(r"(\\+)(###|</turn>)")
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def assemble(turns: list[tuple[str, str]], encode) -> tuple[list[int], list[int]]:
    """(ids, loss mask) of one conversation."""
    ids: list[int] = []
    steps: list[tuple[int, int]] = []
    for role, text in turns:
        ids += [TURN, *encode(escape(role)), BODY]
        start = len(ids)
        ids += encode(escape(text))
        if role == TRAINED_ROLE:
            steps += [(start, 1), (len(ids), -1)]
        ids.append(END)
    delta = np.zeros(len(ids) + 1, np.int64)
    for at, d in steps:
        delta[at] += d
    return ids, np.cumsum(delta)[:-1].tolist()


def read_back(ids: list[int], mask: list[int], decode) -> tuple[list[tuple[str, str]], list[str], str]:
    """(turns, texts under the mask, formatted text), from ids and mask alone."""
    turns, trained, out = [], [], []
    role, start = "", 0
    for at, i in enumerate(ids):
        if i not in READS:
            continue
        segment = decode(ids[start:at]).decode() if at > start else ""
        out += [segment, READS[i]]
        if i == BODY:
            role = unescape(segment)
        elif i == END:
            turns.append((role, unescape(segment)))
            if at > start and all(mask[start:at]):
                trained.append(unescape(segment))
        start = at + 1
    return turns, trained, "".join(out)


def format_conversations(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, ids, loss_mask) of every conversation in ``rows`` (conv_id, turn, role, text)."""
    ship_package(rows.sparkSession)
    path = vocabulary or default_vocabulary()
    none = F.lit("")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")))).alias("turns"))
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def one(b: pa.RecordBatch) -> dict:
        encode = encoder(path).encode
        made = [assemble(list(zip(r, t, strict=True)), encode) for r, t in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist(), strict=True)]
        return {"conv_id": b.column("conv_id"), "ids": [x for x, _ in made], "loss_mask": [m for _, m in made]}

    return map_batches(slim, one, "conv_id long, ids array<int>, loss_mask array<tinyint>", {"ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.int8())})


def digest_of(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the formatted ids and masks read back as, one row per conversation."""
    path = vocabulary or default_vocabulary()

    types = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def one(b: pa.RecordBatch) -> dict:
        decode = encoder(path).decode_bytes
        rows = []
        for ids, mask in zip(b.column("ids").to_pylist(), b.column("loss_mask").to_pylist(), strict=True):
            turns, trained, text = read_back(ids, mask, decode)
            own = "".join(trained)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(own), hashlib.sha256(own.encode()).hexdigest(), len(text)))
        return {"conv_id": b.column("conv_id")} | {n: [r[k] for r in rows] for k, n in enumerate(types)}

    return map_batches(formatted, one, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", types)
