"""Folded text as arrays of code points: the text form of functions.text.fold, many texts in one pass."""

from __future__ import annotations

import numpy as np

from loomgraph.functions.text import _FOLD


class _Table:
    """Folded form of every code point, filled on first use: 0 vanishes, 32 parts words, -1 becomes several characters."""

    def __init__(self):
        self.to = np.full(0x110000, -2, np.int32)
        self.digit = np.zeros(0x110000, bool)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        out = self.to[cps]
        if (out == -2).any():
            for cp in np.unique(cps[out == -2]).tolist():
                f = _FOLD[cp] or ""
                self.to[cp] = 0 if not f else -1 if len(f) > 1 else ord(f)
                if len(f) == 1:
                    self.digit[ord(f)] = f.isdigit()
            out = self.to[cps]
        return out


TABLE = _Table()


def folded(texts: list[str | None]) -> np.ndarray:
    """All texts folded in one array: one space before, between and after the words of each, then a line feed."""
    joined = "".join([f" {t} \n" if t else " \n" for t in texts])
    c = TABLE(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    if (c == -1).any():
        texts = [t.translate(_FOLD) if t else t for t in texts]
        joined = "".join([f" {t} \n" if t else " \n" for t in texts])
        c = TABLE(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    if len(c):
        c[np.cumsum([len(t) + 3 if t else 2 for t in texts]) - 1] = 10
    keep = c != 0
    if not keep.all():
        c = c[keep]
    again = (c == 32) & np.append(False, c[:-1] == 32)
    return c[~again] if again.any() else c
