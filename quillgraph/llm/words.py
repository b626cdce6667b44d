"""The word definition that several operators share."""

from __future__ import annotations

import re

import numpy as np

#: A word is a maximal run of Unicode letters and digits; the underscore is not one.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased words of ``text``, in order."""
    if text.isascii():
        return WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), element-wise on uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
