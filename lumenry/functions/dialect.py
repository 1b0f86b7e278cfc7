"""Search patterns: from a linear-time regex dialect to the JVM's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """The pattern uses what a linear-time engine refuses, or is malformed."""


def _outside_classes(pattern: str):
    """(index, escaped pair or character, inside a class) along a pattern."""
    i, depth = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            yield i, pattern[i : i + 2], depth > 0
            i += 2
            continue
        if c == "[" and not depth:
            depth = 1
        elif c == "]" and depth:
            depth = 0
        yield i, c, depth > 0
        i += 1


def to_jvm(pattern: str, ignore_case: bool = False) -> str:
    """The same language in java.util.regex: $ only at the very end, . but a
    newline, Unicode classes and simple case folding; look-around and
    back-references are errors."""
    if re.search(r"\(\?(?:=|!|<=|<!)", pattern):
        raise PatternError("look-around is not supported")
    out = ""
    multi = bool(re.match(r"\(\?[a-z]*m", pattern))
    for _, piece, inside in _outside_classes(pattern):
        if len(piece) == 2 and piece[1].isdigit() and not inside:
            raise PatternError("back-references are not supported")
        if piece == "$" and not inside and not multi:
            out += r"\z"
        else:
            out += piece
    try:
        re.compile(re.sub(r"\\[pPzZ](?:\{[^}]*\})?", "x", pattern))
    except re.error as e:
        if "inline flags" not in str(e) and "global flags" not in str(e):
            raise PatternError(str(e)) from None
    return f"(?dU{'iu' if ignore_case else ''})" + out


def is_single_line(pattern: str) -> bool:
    """Whether no match can hold a newline, judged from the pattern's text."""
    return not re.search(r"\\n|\\s|\\W|\\D|\\S\\s|\[\^|\(\?[a-z]*s|\n|\\x0[aA]", pattern)


def literal(line: Column, query: str, ignore_case: bool = False) -> Column:
    """Whether a text holds the query."""
    if not ignore_case:
        return F.contains(line, F.lit(query))
    return line.rlike("(?iu)" + jvm_quote(query))


def jvm_quote(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def route_mode(query: str) -> str:
    """symbol for an identifier, else text."""
    return "symbol" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", query) else "text"


MODES = ("auto", "text", "symbol", "literal", "regex")


def check_mode(mode: str, ignore_case: bool) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if ignore_case and mode not in ("literal", "regex"):
        raise ValueError("ignore_case is for literal and regex search")
