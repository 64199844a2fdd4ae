"""Two-stage suffix sorting of the positions that matter, and adjacent common prefixes.

First stage: only suffixes smaller than their successors (type S) are sorted directly.
Second stage: one scan over first-character buckets in rising order induces all other
suffixes (type L): whoever stands before a suffix that is already in place is next in its own
bucket.  A bucket's L suffixes precede its S suffixes.

Suffixes are told apart by their first ``depth`` bytes at least, which is all that a caller
interested in common prefixes of that length needs.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True for each position whose suffix is smaller than the next one (the end counts as smallest)."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    after = np.concatenate([text[1:].astype(np.int16), [-1]])
    now = text.astype(np.int16)
    differs = np.flatnonzero(now != after)
    decides = differs[np.searchsorted(differs, np.arange(n))]  # a run takes its end's type
    return now[decides] < after[decides]


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions with ``wanted`` in the order of their suffixes."""
    n = len(text)
    small = types(text)
    # An L suffix is induced from the next one, so up to the next S suffix all are needed.
    s_at = np.flatnonzero(small)
    starts = np.flatnonzero(wanted)
    if not len(starts):
        return starts
    k = np.searchsorted(s_at, starts)
    upto = np.where(k < len(s_at), s_at[np.minimum(k, max(0, len(s_at) - 1))] if len(s_at) else n, n)
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(upto, n) + 1, -1)
    needed = np.cumsum(mark[: n + 1]) > 0

    raw = text.tobytes()
    direct = np.flatnonzero(needed[:n] & small)
    keys = [raw[p : p + depth] for p in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    heads = text[direct] if len(direct) else np.zeros(0, np.uint8)
    cuts = np.searchsorted(heads, np.arange(257))

    large = needed[:n] & ~small
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(of: np.ndarray) -> None:
        before = of[of > 0] - 1
        before = before[large[before]]
        if not len(before):
            return
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        ends = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(before, ends):
            buckets[text[part[0]]].append(part)

    if needed[n]:
        induce(np.array([n]))
    out: list[np.ndarray] = []
    for c in range(256):
        i = 0
        while i < len(buckets[c]):  # grows while runs of c are induced
            induce(buckets[c][i])
            i += 1
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            induce(own)
        out += buckets[c]
        out.append(own)
        buckets[c] = []
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, block: int = 1 << 12) -> np.ndarray:
    """For each suffix in ``order`` but the first, the bytes it shares with the one before, up to ``depth``."""
    out = np.zeros(max(0, len(order) - 1), np.int32)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for at in range(0, len(out), block):
        a, b = order[at : at + block + 1][:-1], order[at + 1 : at + block + 1]
        differ = rows[a] != rows[b]
        out[at : at + len(b)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out
