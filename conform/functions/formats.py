"""Checks of string formats, as native expressions; each gives true for a valid text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"


_URI_CHAR = r"[!#$&-;=?-Z\[\]_a-z~]"
_IRI_CHAR = r"[!#$&-;=?-Z\[\]_a-z~\x{A0}-\x{10FFFD}]"
_IDN_LABEL = r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}\u00B7-]{0,61}[\p{L}\p{M}\p{N}])?"
_VARIABLE = r"(?:[A-Za-z0-9_.]|%[0-9A-Fa-f]{2})++(?:\*|:[1-9][0-9]{0,3})?"


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern)


def _date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def _ipv6(c: Column) -> Column:
    groups = F.size(F.filter(F.split(c, ":"), lambda x: x != ""))
    shape = c.rlike(r"^[0-9A-Fa-f:]+$") & c.rlike(r"^(:|[0-9A-Fa-f]{1,4}:)") & c.rlike(r":([0-9A-Fa-f]{1,4}|:)$") & ~c.rlike(r":::|[0-9A-Fa-f]{5}") & ~c.rlike(r"::.*::") & ~c.rlike(r"^:[^:]|[^:]:$")
    return shape & F.when(c.contains("::"), groups <= 7).otherwise(groups == 8)


#: Formats that are checked; others pass.
FORMATS: dict[str, Callable[[Column], Column]] = {
    "date": _date,
    "time": _matches(rf"^{_TIME}$"),
    "date-time": lambda c: c.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}[Tt]{_TIME}$") & _date(F.substring(c, 1, 10)),
    "duration": _matches(r"^P(?!$)(\d+W|(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?)$"),
    "email": _matches(rf"^[^\s@\"(),:;<>\[\\\]]+@{_LABEL}(\.{_LABEL})*$"),
    "hostname": lambda c: c.rlike(rf"^{_LABEL}(\.{_LABEL})*\.?$") & (F.length(c) <= 253),
    "ipv4": _matches(rf"^{_OCTET}(\.{_OCTET}){{3}}$"),
    "ipv6": _ipv6,
    "uri": _matches(rf"^[A-Za-z][A-Za-z0-9+.-]*+:(?:{_URI_CHAR}|%[0-9A-Fa-f]{{2}})*+$"),
    "uri-reference": _matches(rf"^(?:{_URI_CHAR}|%[0-9A-Fa-f]{{2}})*+$"),
    "iri": _matches(rf"^[A-Za-z][A-Za-z0-9+.-]*+:(?:{_IRI_CHAR}|%[0-9A-Fa-f]{{2}})*+$"),
    "iri-reference": _matches(rf"^(?:{_IRI_CHAR}|%[0-9A-Fa-f]{{2}})*+$"),
    "uri-template": _matches(rf"^(?:{_IRI_CHAR}|%[0-9A-Fa-f]{{2}}|\{{[+#./;?&=,!@|]?{_VARIABLE}(?:,{_VARIABLE})*+\}})*+$"),
    "idn-email": _matches(rf"^[^\s@\"(),:;<>\[\\\]]++@{_IDN_LABEL}(?:[.\u3002]{_IDN_LABEL})*+$"),
    "idn-hostname": lambda c: c.rlike(rf"^{_IDN_LABEL}(?:[.\u3002]{_IDN_LABEL})*+\.?$") & (F.length(c) <= 253),
    "regex": lambda c: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c).isNotNull(),
    "uuid": _matches(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    "json-pointer": _matches(r"^(/([^~/]|~[01])*)*$"),
    "relative-json-pointer": _matches(r"^(0|[1-9]\d*)(#|(/([^~/]|~[01])*)*)$"),
}


def check_format(name: str, text: Column) -> Column | None:
    """Whether a text has the format; None for a format that is not checked."""
    return FORMATS[name](text) if name in FORMATS else None
