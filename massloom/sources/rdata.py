"""Saved R workspaces (.rdata): lists, character, number and logical vectors, with their names."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct

# Type codes of R's serialisation.
NIL, SYMBOL, PAIRS, CHARS, LOGICAL, INTEGER, REAL, STRINGS, LIST, REFERENCE, GLOBAL, EMPTY, BASE = 254, 1, 2, 9, 10, 13, 14, 16, 19, 255, 253, 242, 241
OPENERS = ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress))


class _Reader:
    """Big-endian items, one after another; symbols are numbered as they come."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.symbols = data, at, []

    def ints(self, n: int) -> tuple[int, ...]:
        self.at += 4 * n
        return struct.unpack_from(f">{n}i", self.data, self.at - 4 * n)

    def attributes(self, there: bool) -> dict:
        return self.item() if there else {}

    def item(self):
        flags = self.ints(1)[0]
        kind, has_attributes, has_tag = flags & 255, bool(flags & 512), bool(flags & 1024)
        if kind in (NIL, GLOBAL, EMPTY, BASE):
            return None
        if kind == SYMBOL:
            self.symbols.append(self.item())
            return self.symbols[-1]
        if kind == REFERENCE:
            return self.symbols[(flags >> 8 or self.ints(1)[0]) - 1]
        if kind == PAIRS:
            out = {}
            while kind == PAIRS:  # a chain of pairs is a dict by tag
                self.attributes(has_attributes)
                tag = self.item() if has_tag else len(out)
                out[tag] = self.item()
                flags = self.ints(1)[0]
                kind, has_attributes, has_tag = flags & 255, bool(flags & 512), bool(flags & 1024)
            if kind != NIL:
                raise ValueError(f"R item {kind} ends a list of pairs")
            return out
        n = self.ints(1)[0]
        if kind == CHARS:
            self.at += max(n, 0)
            return None if n < 0 else self.data[self.at - n : self.at].decode("utf-8", "replace")
        if kind in (STRINGS, LIST):
            value = [self.item() for _ in range(n)]
        elif kind in (LOGICAL, INTEGER):
            value = [None if x == -(2**31) else bool(x) if kind == LOGICAL else x for x in self.ints(n)]
        elif kind == REAL:
            self.at += 8 * n
            value = list(struct.unpack_from(f">{n}d", self.data, self.at - 8 * n))
        else:
            raise ValueError(f"R item of type {kind} is not read")
        names = (self.attributes(has_attributes) or {}).get("names")
        return dict(zip(names, value, strict=True)) if names else value


def read_rdata(data: bytes) -> dict:
    """The saved objects by name; named lists are dicts, other vectors lists."""
    for magic, opened in OPENERS:
        if data.startswith(magic):
            data = opened(data)
            break
    if data[:5] not in (b"RDX2\n", b"RDX3\n") or data[5:7] != b"X\n":
        raise ValueError("not a binary R workspace")
    reader = _Reader(data, 7)
    version = reader.ints(3)[0]
    if version == 3:  # the name of the native encoding
        reader.at += 4 + struct.unpack_from(">i", data, reader.at)[0]
    return reader.item() or {}
