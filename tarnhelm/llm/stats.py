"""Rule statistics of one text, in numpy, over its whole length."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Shape statistics, all ratios, so that a document's length alone makes it neither good nor odd.
SHAPE = (
    "word_len", "symbol", "dup_line", "repeat", "upper", "punct", "digit", "mark", "distinct", "head", "pipe", "bang", "end_dot", "run",
    # The same drawn towards the usual value in short texts, where a ratio says little.
    "symbols_a_word", "pipe_s", "bang_s", "head_s", "word_len_s", "run_s")

UPPER, LOWER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER = range(7)
_KNOWN = 0x3000


def _class_table() -> np.ndarray:
    kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Cc": SPACE}
    table = np.full(_KNOWN + 1, OTHER, np.uint8)
    for c in range(_KNOWN):
        cat = unicodedata.category(chr(c))
        table[c] = kinds.get(cat, LOWER if cat[0] == "L" else PUNCT if cat[0] == "P" else SYMBOL if cat[0] == "S" else OTHER)
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    return table


_TABLE: list[np.ndarray] = []


def char_counts(text: str) -> np.ndarray:
    """Code points of each character class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_TABLE[0][np.minimum(points, _KNOWN)], minlength=7)


def word_ids(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first occurrences included."""
    n = len(ids) - window + 1
    if n < 2 or int(ids.max()) == len(ids) - 1:  # all words differ
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if not all((ids[a + j] == ids[b + j]).all() for j in range(window)):  # a hash collision: count by the words themselves
        seen: dict[tuple, list[int]] = {}
        for p in range(n):
            seen.setdefault(tuple(ids[p : p + window].tolist()), []).append(p)
        a = b = np.array([p for ps in seen.values() if len(ps) > 1 for p in ps], np.int64)
    cover = np.zeros(len(ids) + 1, np.int32)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def rule_counts(text: str) -> tuple[list[str], int, int, int, int, int]:
    """(words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORD.findall(text)
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif WORD.search(line):
            lines.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    repeat = repeated_words(word_ids(words)) if len(words) > WINDOW else 0
    return words, len(words), sum(map(len, words)), symbols, dup, repeat


def shape(text: str, counts) -> list[float]:
    """The SHAPE ratios; an empty text is all zeros."""
    words, n, chars, symbols, dup, repeat = counts
    if not n:
        return [0.0] * len(SHAPE)
    by = char_counts(text)
    letters = max(1, int(by[UPPER] + by[LOWER]))
    distinct = len(set(words))
    lines = text.count("\n") + 1
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    ends = sum(1 for w in words if w[-1] in ".,;:?")
    pipes, bangs, heads = text.count("|"), text.count("!"), sum(map(str.isupper, words))
    return [
        chars / n, symbols / chars, dup / lines, repeat / n, by[UPPER] / letters, by[PUNCT] / chars, by[DIGIT] / chars,
        by[OTHER] / chars, distinct / n**0.75, heads / n, pipes / n, bangs / n, ends / n, same / n,
        symbols / (n + 20), pipes / (n + 20), bangs / (n + 20), heads / (n + 20), (chars + 5 * 50) / (n + 50), same / (n + 50),
    ]
