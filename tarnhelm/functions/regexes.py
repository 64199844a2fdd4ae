"""Spelling patterns so that Java's regex engine reads them as ECMAScript's does.

Word edges are ASCII (Java's ``\\b`` isn't), white space is ECMAScript's (Java's ``\\s`` lacks
no-break spaces), and case-insensitive Unicode patterns also fold the long s and the Kelvin sign.
"""

from __future__ import annotations

WORD = "A-Za-z0-9_"
#: Under case-insensitive Unicode matching two more characters count as word characters.
WORD_I = WORD + "ſK"
LETTER_I = "A-Za-zſK"
#: White space: tab to carriage return, space, no-break and other Unicode spaces, line separators, byte order mark.
WS_CHARS = "\\t\\n\\x0B\\f\\r    -     　﻿"
WS = f"[{WS_CHARS}]"


def edge(word: str = WORD) -> str:
    """A word edge on either side."""
    w = f"[{word}]"
    return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"


def any_case(word: str) -> str:
    """A word in either case, as a case-insensitive Unicode pattern reads it."""
    more = {"S": "ſ", "K": "K"}
    return "".join(f"[{c.upper()}{c.lower()}{more.get(c.upper(), '')}]" if c.isalpha() else c for c in word)


def any_of(words: list[str], fold: bool = True) -> str:
    return "(?:" + "|".join(any_case(w) if fold else w for w in words) + ")"
