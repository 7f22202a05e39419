"""Globs as regular expressions, so that Spark evaluates them as literals inside generated code."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = "(?!)"


def clean(path: str) -> str:
    """Forward slashes, then lexical cleaning."""
    return posixpath.normpath(path.replace("\\", "/")) if path else "."


def _segment(s: str) -> str | None:
    """One path segment of a glob; None if it is malformed."""
    out, i = "", 0
    while i < len(s):
        c = s[i]
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(s) and s[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = s.find("]", i + 2)
            if end < 0:
                return None
            body = s[i + 1 : end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            out += "[" + "^/" * negated + re.sub(r"([\\\[\]&~])", r"\\\1", body) + "]"
            i = end
        else:
            out += re.sub(r"([\\.^$|()+{}\[\]*?])", r"\\\1", c)
        i += 1
    return out


def alternatives(pattern: str) -> list[str] | None:
    """Brace alternatives, expanded; None if braces are unbalanced."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            start = i if depth == 1 else start
        elif c == "}":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0:
                parts, level, last = [], 0, start + 1
                for j in range(start + 1, i):
                    level += (pattern[j] == "{") - (pattern[j] == "}")
                    if pattern[j] == "," and level == 0:
                        parts.append(pattern[last:j])
                        last = j + 1
                parts.append(pattern[last:i])
                rest = [alternatives(pattern[:start] + p + pattern[i + 1 :]) for p in parts]
                return None if any(r is None for r in rest) else [x for r in rest for x in r]
    return [pattern] if depth == 0 else None


def glob_regex(pattern: str) -> str | None:
    """A regular expression for whole paths, None if the glob is empty or malformed. ** stands for any segments, none too."""
    if not pattern.strip():
        return None
    every = alternatives(clean(pattern.strip()))
    if every is None:
        return None
    out = []
    for one in every:
        rx, lead = "", ""  # lead: the slash owed before the next segment
        segments = one.split("/")
        for k, s in enumerate(segments):
            if s == "**":
                if k == len(segments) - 1:
                    rx += "(?:/.*)?" if k else ".*"
                else:
                    rx += lead + "(?:[^/]+/)*"
                    lead = ""
                continue
            part = _segment(s)
            if part is None:
                return None
            rx += lead + part
            lead = "/"
        out.append(rx)
    return "^(?:" + "|".join(out) + ")$"


def valid(pattern: str) -> bool:
    return glob_regex(pattern) is not None


def matches(pattern: str, path: str) -> bool:
    rx = glob_regex(pattern)
    return bool(rx and re.search(rx, clean(path)))


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Whether a normalised path column matches any glob; malformed globs match nothing."""
    known = [rx for rx in map(glob_regex, patterns) if rx]
    return column.rlike("|".join(known)) if known else F.lit(False)
