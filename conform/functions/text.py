"""Scalar functions over texts, paths, pointers and places in a text. Offsets are in bytes, columns in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    """ASCII letters and digits in lower case, all else single hyphens, none at the ends."""
    return F.btrim(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", "-")), F.lit("-"))


def title_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def string_to_bool(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def linkify(text: Column) -> Column:
    """Bare URLs in angle brackets; closing dots, commas and semicolons stay outside, URLs after ``<`` or ``(`` stay as they are."""
    return F.regexp_replace(text, r"(?<![<(])(https?://(?:[^\s>\"'`]*[^\s>\"'`.,;])?)(?=[.,;]*(?:[\s>\"'`]|\z))([.,;]*)", "<$1>$2")


def line_col(content: Column, offset: Column) -> Column:
    """``struct<line, col>``, both from 1, of a byte offset; offsets past the end are the end."""
    before = F.decode(F.substring(F.encode(content, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    last = F.substring_index(before, "\n", -1)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(last) + 1).alias("col"))


def line_col_offset(content: Column, line: Column, col: Column) -> Column:
    """The byte offset of a line and a column."""
    lines = F.split(content, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    return before + F.octet_length(F.substring(F.get(lines, line - 1), F.lit(1), col - 1))


def first_content_offset(content: Column) -> Column:
    """The byte offset of the first line that is neither blank nor a comment; 0 if there is none."""
    lead = F.regexp_extract(content, r"^((?:[^\S\n]*+(?:#[^\n]*+|//[^\n]*+)?+\n)*+[^\S\n]*+)(?=\S)(?!#|//)", 1)
    return F.octet_length(lead)


def pointer_span(content: Column, pointer: Column) -> Column:
    """``struct<offset, length>`` in bytes of a pointer's last segment: first ``"segment"``, else ``segment:`` where a line begins; (0, 0) if there is neither."""
    segment = F.substring_index(pointer, "/", -1)
    quoted = F.concat(F.lit('"'), segment, F.lit('"'))
    at = F.position(quoted, content)
    key = F.concat(F.lit(r"(?m)^([^\S\n]*)\Q"), segment, F.lit(r"\E:"))
    line = F.regexp_instr(content, key)
    rest = F.substring(content, line, F.length(content))
    lead = F.length(rest) - F.length(F.ltrim(rest))
    start = lambda n: F.octet_length(F.substring(content, F.lit(1), n))
    span = lambda offset, length: F.struct(offset.cast("int").alias("offset"), length.cast("int").alias("length"))
    none = span(F.lit(0), F.lit(0))
    return (
        F.when(pointer.isin("", "/"), span(first_content_offset(content), F.lit(0)))
        .when(segment == "", none)
        .when(at > 0, span(start(at - 1), F.octet_length(quoted)))
        .when(line > 0, span(start(line - 1 + lead), F.octet_length(segment)))
        .otherwise(none)
    )


def label(instance_path: Column, schema_path: Column) -> Column:
    """``path in schema_path``; an empty instance path reads ``here``."""
    path = F.when(instance_path == "", F.lit("here")).otherwise(instance_path)
    return F.when(schema_path == "", path).otherwise(F.concat(path, F.lit(" in "), schema_path))


def pointer_decode(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def to_schema_pointer(path: Column) -> Column:
    """A JSON pointer, JSONPath or dotted path as a schema pointer; null for a path that is none of them."""
    full = F.when(path.startswith("$"), F.substring(path, F.lit(2), F.length(path))).otherwise(F.concat(F.lit("."), path))
    step = r"""\.[^.\[]+|\[[^\]'"]*\]|\['[^']*'\]|\["[^"]*"\]"""
    name = lambda s: F.regexp_replace(F.regexp_replace(s, r"""^(\.|\[['"])""", "/properties/"), r"""['"]\]$""", "")
    steps = F.transform(F.regexp_extract_all(full, F.lit(f"({step})"), F.lit(1)), lambda s: F.when(s.rlike(r"""^\[[^'"]"""), F.lit("/items")).when(s == "[]", F.lit("/items")).otherwise(name(s)))
    return F.when(path.startswith("/"), path).when(full.rlike(f"^({step})*$"), F.array_join(steps, ""))


def instance_prefix(schema_pointer: Column) -> Column:
    """The instance path that a schema pointer describes."""
    return F.regexp_replace(F.regexp_replace(schema_pointer, r"/items(?=/|$)", ""), r"/properties/([^/]+)", "/$1")


def escape_command(text: Column) -> Column:
    """Percent signs and line ends as CI commands want them."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved in the text alone."""
    start = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.concat(start, F.array_join(kept, "/"))


#: Characters of a reference's fragment that have no place in a URI.
ILLEGAL = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D", "|": "%7C", "\\": "%5C", "^": "%5E", "[": "%5B", "]": "%5D"}


def encode_fragment(ref: Column) -> Column:
    """Percent-encode what a reference's fragment may not hold; percent signs that encode already stay."""
    head = F.substring_index(ref, "#", 1)
    tail = F.regexp_replace(F.substring(ref, F.length(head) + 2, F.length(ref)), r"%(?![0-9A-Fa-f]{2})", "%25")
    for c, code in ILLEGAL.items():
        tail = F.replace(tail, F.lit(c), F.lit(code))
    return F.when(ref.contains("#"), F.concat(head, F.lit("#"), tail)).otherwise(ref)


def ref_name(ref: Column) -> Column:
    return F.substring_index(ref, "/", -1)


def version_key(version: Column) -> Column:
    """An orderable key of a semantic version; null for a text that is none. A release stands after its pre-releases."""
    core = F.split(F.substring_index(F.substring_index(version, "+", 1), "-", 1), r"\.")
    fine = version.rlike(r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$")
    pre = F.regexp_extract(version, r"^\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.when(fine, F.struct(F.get(core, 0).cast("long").alias("major"), F.get(core, 1).cast("long").alias("minor"), F.get(core, 2).cast("long").alias("patch"), (pre == "").cast("int").alias("release"), parts.alias("pre")))
