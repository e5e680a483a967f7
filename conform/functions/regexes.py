"""ECMA regular expressions: repaired as text (what a migration writes into schemas), and put into Java's dialect (what values are matched with).

Patterns belong to schemas, so both run when a query is built, or once for each distinct pattern; never per row.
"""

from __future__ import annotations

import re

_QUANTIFIER = re.compile(r"\{\d+(,\d*)?\}")
_SHORTHAND = set("dDwWsS")


def java_regex(pattern: str) -> str:
    """The same language in Java's syntax: braces that quantify nothing and brackets inside classes are escaped, a range that ends
    or begins with a shorthand has a plain hyphen, end anchors are the ends of the text, and ``\\cX`` and ``\\u`` stay as they are."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e in "AZz" and not in_class:
                out.append({"A": "^", "Z": "$", "z": "$"}[e])
            elif e == "/" or e == "-" and not in_class:
                out.append(e)
            else:
                out.append(c + e)
                if in_class and e in _SHORTHAND and pattern[i + 2 : i + 3] == "-" and pattern[i + 3 : i + 4] not in ("]", ""):
                    out.append("\\-")
                    i += 1
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[":
                c = "\\["
            elif c == "&" and pattern[i + 1 : i + 2] == "&":
                c = "\\&"
            elif c == "-" and pattern[i + 1 : i + 2] == "\\" and pattern[i + 2 : i + 3] in _SHORTHAND:
                c = "\\-"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]":
                out.append("(?!)")
                i += 2
                in_class = False
                continue
            if pattern[i + 1 : i + 3] == "^]":
                out.append(r"[\s\S]")
                i += 3
                in_class = False
                continue
        elif c == "{" and not _QUANTIFIER.match(pattern, i):
            c = "\\{"
        elif c == "}" and not _closes(pattern, i):
            c = "\\}"
        elif c == "$":
            c = r"\z" if i == len(pattern) - 1 else c
        out.append(c)
        i += 1
    return "".join(out)


def _closes(pattern: str, i: int) -> bool:
    start = pattern.rfind("{", 0, i)
    return start >= 0 and bool(m := _QUANTIFIER.match(pattern, start)) and m.end() == i + 1 and (start == 0 or pattern[start - 1] != "\\")


_PIECE = re.compile(r"\\[pPu]\{[^}]*\}|\\.|\[\^?\]?|.", re.DOTALL)


def repaired_regex(pattern: str) -> str:
    """An ECMA pattern that stricter dialects take as well and that means the same; repairing twice changes nothing more.

    Braces that quantify nothing are escaped; ``\\A`` and ``\\Z`` become ``^`` and ``$``; inside a class ``\\d`` becomes ``0-9``, a hyphen after another
    shorthand (unless the class ends there) and an opening bracket are escaped.
    """
    closing: set[int] = set()
    pieces = [(m.start(), m.group()) for m in _PIECE.finditer(pattern)]
    out, in_class, shorthand = [], False, False
    for n, (at, piece) in enumerate(pieces):
        after_shorthand, shorthand = shorthand, False
        if in_class:
            if piece[0] == "[":  # an opening bracket, and what the pattern of pieces took with it
                ends = piece.endswith("]")
                in_class = not ends
                piece = "\\[" + piece[1:]
            elif piece == "]":
                in_class = False
            elif piece == "\\d":
                piece = "0-9"
            elif piece in ("\\w", "\\s", "\\W", "\\D", "\\S"):
                shorthand = True
            elif piece == "-" and after_shorthand and n + 1 < len(pieces) and pieces[n + 1][1] != "]":
                piece = "\\-"
        elif piece[0] == "[":
            in_class = True
        elif piece in ("\\A", "\\Z"):
            piece = "^" if piece == "\\A" else "$"
        elif piece == "{" and (m := _QUANTIFIER.match(pattern, at)):
            closing.add(m.end() - 1)
        elif piece in "{}" and at not in closing:
            piece = "\\" + piece
        out.append(piece)
    return "".join(out)
