"""Global alignment with affine gaps (Gotoh), in numpy."""

from __future__ import annotations

import math
import pkgutil
from collections.abc import Callable
from functools import cache

import numpy as np

NEG = -(1 << 29)
# Groups of residues that often stand for one another.
SIMILAR = ("ILMV", "FWY", "KRH", "DE", "NQ", "ST", "AG")


def class_scores(match: int = 6, similar: int = 1, mismatch: int = -3) -> Callable[[str, str], int]:
    """A score by rule: equal, of one group, or other."""
    group = {aa: k for k, g in enumerate(SIMILAR) for aa in g}

    def score(a: str, b: str) -> int:
        return match if a == b else similar if a in group and group.get(a) == group.get(b) else mismatch

    return score


def read_score_matrix(text: str) -> Callable[[str, str], int]:
    """Scores from the text of a substitution matrix file (BLOSUM90 and its like): "#" comments, a header of residues, rows."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    columns = lines[0]
    table = {(r[0], c): int(v) for r in lines[1:] for c, v in zip(columns, r[1:], strict=True)}
    worst = min(table.values())
    return lambda a, b: table.get((a, b), worst)


@cache
def blosum90() -> Callable[[str, str], int]:
    """The matrix that modified sites are mapped with by default."""
    return read_score_matrix(pkgutil.get_data(__package__, "blosum90.txt").decode())


def align(a: str, b: str, score: Callable[[str, str], int], gap_open: int = -10, gap_extend: int = -1) -> tuple[int, np.ndarray, int, int, np.ndarray]:
    """(score, for each residue of a the 1-based place in b or 0, columns, matches, its 1-based column) of a best global alignment.

    A gap of n residues costs gap_open + n * gap_extend.  Of equal alignments the diagonal is preferred, then a gap in b.
    Rows are filled as vectors; the gap along a row is a running maximum.  The rows' scores are kept at about every root of
    n-th row, and the way back is found in the rows between two of these, filled once more; so memory grows with the length times
    its root, 60 MB for two of 35,000.
    """
    n, m = len(a), len(b)
    letters = {c: k for k, c in enumerate(sorted(set(a + b)))}
    table = np.array([[score(x, y) for y in letters] for x in letters], np.int32).reshape(len(letters), len(letters))
    ia, ib = np.array([letters[c] for c in a], int), np.array([letters[c] for c in b], int)
    steps = np.arange(m + 1, dtype=np.int32)

    def fill(best: np.ndarray, down: np.ndarray, first: int, last: int, ways: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best scores, and those that end in a gap in b, of row ``last``; ``ways`` gets how each cell was reached."""
        for i in range(first, last + 1):
            opened = best + (gap_open + gap_extend)
            down = np.maximum(opened, down + gap_extend)
            diagonal = np.concatenate((_LOW, best[:-1] + table[ia[i - 1], ib]))
            base = np.maximum(diagonal, down)
            reach = np.maximum.accumulate(base - gap_extend * steps)
            along = np.concatenate((_LOW, reach[:-1] + (gap_open + gap_extend * steps[1:])))
            best = np.maximum(base, along)
            if ways is not None:
                began = np.concatenate(([False], along[1:] == best[:-1] + (gap_open + gap_extend)))
                ways[i - first] = _DIAGONAL * (best == diagonal) | _DOWN * (best == down) | _OPENED_DOWN * (down == opened) | _OPENED_ALONG * began
        return best, down

    start = gap_open + gap_extend * steps
    start[0] = 0
    each = max(1, math.isqrt(n))
    held = [(start, np.full(m + 1, NEG, np.int32))]
    for first in range(1, n + 1, each):
        held.append(fill(*held[-1], first, min(n, first + each - 1)))
    total = int(held[-1][0][m])
    to, place = np.zeros(n, int), np.zeros(n, int)
    ways, low = np.zeros((each, m + 1), np.uint8), n + 1
    i, j, columns, matches, state = n, m, 0, 0, 0
    while i or j:
        if i and i < low:  # the rows that end with row i
            block = (i - 1) // each
            low = block * each + 1
            fill(*held[block], low, min(n, low + each - 1), ways)
        way = int(ways[i - low, j]) if i else _OPENED_ALONG * (j == 1)
        if not state:
            if i and j and way & _DIAGONAL:
                to[i - 1] = j
                place[i - 1] = columns
                matches += a[i - 1] == b[j - 1]
                i, j, columns = i - 1, j - 1, columns + 1
                continue
            state = _DOWN if i and way & _DOWN else _OPENED_ALONG
        if state == _DOWN:
            place[i - 1] = columns
            state = 0 if way & _OPENED_DOWN else state
            i -= 1
        else:
            state = 0 if way & _OPENED_ALONG else state
            j -= 1
        columns += 1
    return total, to, columns, matches, columns - place


_LOW = np.array([NEG], np.int32)
_DIAGONAL, _DOWN, _OPENED_DOWN, _OPENED_ALONG = 1, 2, 4, 8
