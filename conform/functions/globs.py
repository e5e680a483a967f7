"""Globs as regular expressions, written once for each pattern; matching itself is ``rlike`` on the executors.

``*`` and ``?`` stay inside a path segment, ``**`` as a whole segment crosses segments, ``[..]`` may match a separator, braces
nest up to ten deep, a backslash escapes, each leading ``!`` turns the result round; ``/`` in a pattern also matches ``\\``.
Characters are matched where some engines match bytes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR, INSIDE = r"[/\\]", r"[^/\\]"
DEEPEST = 10
NEVER = "(?!)"
#: Escapes that stand for control characters.
CONTROLS = {"b": "\\x08", "n": "\\n", "r": "\\r", "t": "\\t"}


class BadGlob(ValueError):
    """A pattern that never matches, such as an unclosed class or brace."""


def glob_to_regex(pattern: str, ignore_case: bool = False, captures: bool = False) -> tuple[str, bool]:
    """The regular expression for whole texts, and whether its result is to be turned round. A bad pattern gives one that never matches."""
    body = pattern.lstrip("!")
    turned = (len(pattern) - len(body)) % 2 == 1
    try:
        text, end = _sequence(body, 0, 0, captures, at_start=True)
        if end != len(body):
            raise BadGlob(pattern)
    except BadGlob:
        text = NEVER
    return f"(?s){'(?i)' if ignore_case else ''}^{text}\\z", turned


def _sequence(p: str, i: int, depth: int, captures: bool, at_start: bool) -> tuple[str, int]:
    """Read up to the end, or inside braces to ``,`` or ``}``."""
    group = (lambda x: f"({x})") if captures else (lambda x: x)
    out: list[str] = []
    segment = at_start  # whether a segment begins here
    while i < len(p):
        c = p[i]
        if depth and c in ",}":
            break
        if c == "*":
            j = i
            while j < len(p) and p[j] == "*":
                j += 1
            ends = j == len(p) or p[j] == "/" or (depth and p[j] in ",}")
            if j - i == 2 and segment and ends:
                if j < len(p) and p[j] == "/":
                    out.append(group(f"(?:.*{SEPARATOR})?"))
                    i = j + 1
                    continue
                out.append(group(".*"))
            else:
                out.append(group(f"{INSIDE}*"))
            i, segment = j, False
            continue
        if c == "?":
            out.append(group(INSIDE))
        elif c == "[":
            text, i = _class(p, i)
            out.append(group(text))
            segment = False
            continue
        elif c == "{":
            if depth >= DEEPEST:
                raise BadGlob(p)
            options, i = _braces(p, i + 1, depth + 1, captures, segment)
            out.append(f"(?:{options})" if not captures else f"({options})")
            segment = False
            continue
        elif c == "\\":
            if i + 1 >= len(p):
                raise BadGlob(p)
            i += 1
            out.append(CONTROLS.get(p[i], re.escape(p[i])))
        elif c == "/":
            out.append(SEPARATOR)
            i, segment = i + 1, True
            continue
        else:
            out.append(re.escape(c))
        i, segment = i + 1, False
    return "".join(out), i


def _braces(p: str, i: int, depth: int, captures: bool, segment: bool) -> tuple[str, int]:
    options = []
    while True:
        text, i = _sequence(p, i, depth, captures, segment)
        options.append(text)
        if i >= len(p):
            raise BadGlob(p)
        i += 1
        if p[i - 1] == "}":
            return "|".join(options), i


def _class(p: str, i: int) -> tuple[str, int]:
    i += 1
    negated = p[i : i + 1] in ("^", "!")
    i += negated
    parts, first = [], True
    quote = lambda c: "\\" + c if c in "\\]^[-&" else c
    while True:
        if i >= len(p):
            raise BadGlob(p)
        c = p[i]
        if c == "]" and not first:
            break
        first = False
        if c == "\\" and i + 1 < len(p):
            i += 1
            c = {"b": "\b", "n": "\n", "r": "\r", "t": "\t"}.get(p[i], p[i])
        low, i = c, i + 1
        if p[i : i + 1] == "-" and p[i + 1 : i + 2] not in ("]", ""):
            high = p[i + 1]
            i += 2
            if high == "\\" and i < len(p):
                high, i = p[i], i + 1
            if low <= high:
                parts.append(f"{quote(low)}-{quote(high)}")
        else:
            parts.append(quote(low))
    if not parts:
        return (r"[\s\S]" if negated else NEVER), i + 1
    return f"[{'^' if negated else ''}{''.join(parts)}]", i + 1


def glob_match(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a path matches one pattern."""
    regex, turned = glob_to_regex(pattern, ignore_case)
    return ~path.rlike(regex) if turned else path.rlike(regex)


def glob_captures(path: Column, pattern: str) -> Column:
    """What each wildcard of the pattern matched, left to right; null for a path that does not match."""
    regex, _ = glob_to_regex(pattern, captures=True)
    n = re.compile(regex.replace("\\z", "\\Z")).groups
    return F.when(path.rlike(regex), F.array(*[F.regexp_extract(path, regex, i + 1) for i in range(n)]))


def escape_glob(text: Column) -> Column:
    """The pattern that matches a text literally."""
    return F.regexp_replace(text, r"([?*\[\]{}!\\])", r"\\$1")


def ordered_parts_match(pattern: str, text: Column) -> Column:
    """Whether the literal parts between ``**`` stand in the text in order; ``**`` crosses everything. Each part takes the first place that it finds."""
    parts = [p for p in pattern.split("**") if p]
    if not parts:
        return F.lit(True) if pattern else text == ""
    steps = [re.escape(p) if i == 0 and not pattern.startswith("**") else f"(?>.*?{re.escape(p)})" for i, p in enumerate(parts)]
    return text.rlike("(?s)^" + "".join(steps) + ("" if pattern.endswith("**") else r"\z"))


_LITERAL = re.compile(r"^[^*?\[\]{}!\\]+$")


def classify(pattern: str) -> tuple[str, str]:
    """``literal`` (whole path), ``basename`` (``**/name``), ``extension`` (``**/*.ext``) with its key, else ``rest`` (see :func:`required_literal`)."""
    if _LITERAL.match(pattern):
        return "literal", pattern
    if pattern.startswith("**/"):
        tail = pattern[3:]
        if _LITERAL.match(tail) and "/" not in tail:
            return "basename", tail
        if re.fullmatch(r"\*\.[^*?\[\]{}!\\/.]+", tail):
            return "extension", tail[2:]
    return "rest", ""


#: Characters of a literal that serve as a key, from a path's beginning, end, or anywhere in it.
KEY_LENGTH, INNER_LENGTH = 32, 6


def required_literal(pattern: str) -> tuple[str, str]:
    """A text that every path of a glob must begin with (``prefix``), end with (``suffix``) or hold (``inner``), the longest there is; ``rest`` if there is none.

    Classes and braces end a literal; so does ``**``, which takes the slashes beside it along, as it may stand for no folder at all.
    """
    runs: list[list[str]] = [[]]
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            runs[-1].append(pattern[i + 1])
            i += 2
        elif pattern.startswith("**", i):
            while runs[-1] and runs[-1][-1] == "/":
                runs[-1].pop()
            while i < n and pattern[i] in "*/":
                i += 1
            runs.append([])
        elif c in "*?":
            runs.append([])
            i += 1
        elif c in "[{":
            depth, close = 0, {"[": "]", "{": "}"}[c]
            while i < n:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == c:
                    depth += 1
                elif pattern[i] == close:
                    depth -= 1
                    if depth == 0 or c == "[":
                        break
                i += 1
            if c == "[" or i >= n:  # a class's end is not always the first bracket: nothing behind it is relied on
                runs.append([])
                return _longest([*runs, []])
            runs.append([])
            i += 1
        else:
            runs[-1].append(c)
            i += 1
    return _longest(runs)


def _longest(runs: list[list[str]]) -> tuple[str, str]:
    texts = ["".join(r) for r in runs]
    found = [(len(texts[0][:KEY_LENGTH]), 2, "prefix", texts[0][:KEY_LENGTH])]
    if len(texts) > 1:
        found.append((len(texts[-1][-KEY_LENGTH:]), 1, "suffix", texts[-1][-KEY_LENGTH:]))
        found += [(min(len(x), INNER_LENGTH), 0, "inner", x[:INNER_LENGTH]) for x in texts[1:-1]]
    length, _, kind, text = max(found)
    return (kind, text) if length else ("rest", "")


def expand_braces(pattern: str, most: int = 64) -> list[str]:
    """The alternatives of a pattern's first-level braces, so that simple ones can be classified; too many leave it as it is."""
    m = re.search(r"(?<!\\)\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    out = [x for option in m.group(1).split(",") for x in expand_braces(pattern[: m.start()] + option + pattern[m.end() :], most)]
    return out if len(out) <= most else [pattern]


def pattern_rows(spark: SparkSession, patterns: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A table of patterns: the given columns, of which ``pattern`` is one, with ``regex, turned, strategy, key``; braces are expanded."""
    at = list(columns).index("pattern")
    rows = []
    for row in patterns:
        for p in expand_braces(row[at]):
            regex, turned = glob_to_regex(p)
            strategy, key = classify(p) if not turned else ("rest", "")
            if strategy == "rest" and not turned:
                strategy, key = required_literal(p)
            rows.append((*row, regex, turned, strategy, key))
    kinds = ", ".join(f"{c} {'int' if isinstance(patterns[0][i], int) else 'string'}" for i, c in enumerate(columns)) if patterns else ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame(rows, f"{kinds}, regex string, turned boolean, strategy string, key string")
