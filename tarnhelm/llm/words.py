"""Words as 64-bit codes, a whole batch of texts at once in numpy.

A word is a run of letters and digits in lower case.  Its code is a polynomial hash of
its code points, so equal words have equal codes and others don't but for chance.
"""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15
_CACHE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter or a digit."""
    if "letters" not in _CACHE:
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0x20
        table = np.zeros(0x110000, bool)
        for m in re.finditer(r"[^\W_]+", points.tobytes().decode("utf-32-le")):
            table[m.start() : m.end()] = True
        _CACHE["letters"] = table
    return _CACHE["letters"]


def _powers(n: int) -> np.ndarray:
    if len(_CACHE.get("powers", ())) < n:
        x = np.full(max(n, 1 << 12), _FACTOR, _U)
        x[0] = 1
        with np.errstate(over="ignore"):
            _CACHE["powers"] = np.cumprod(x)
    return _CACHE["powers"]


def codes(texts: list[str]) -> list[np.ndarray]:
    """The codes of each text's words, in their order."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _letters()[points], [False]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    if not len(starts):
        return [np.zeros(0, _U) for _ in texts]
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    chars = points[place + np.repeat(starts, sizes)].astype(_U)
    with np.errstate(over="ignore"):
        found = mix(np.add.reduceat((chars + _U(1)) * _powers(int(sizes.max()))[place], first) + sizes.astype(_U))
    return np.split(found, np.searchsorted(starts, ends)[:-1])
