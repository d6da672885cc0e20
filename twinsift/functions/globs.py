"""File globs as regular expressions, for ``rlike`` on a path column and for Python."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """``**`` spans folders (a leading or inner ``**/`` also none), ``*`` and ``?`` stay within one, ``{a,b}`` are choices.

    Dot files match like any other. The expression is anchored.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and (close := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : close]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "^" + "".join(out) + "$"


def globs_to_regex(patterns: list[str] | tuple[str, ...]) -> str:
    """One expression for several globs; it matches nothing when there are none."""
    return "|".join(glob_to_regex(p) for p in patterns) or r"^(?!)$"


def matches(path: str, patterns: list[str] | tuple[str, ...]) -> bool:
    return re.match(globs_to_regex(patterns), path) is not None
