"""JSON values as columns: one interface over VARIANT columns and over ordinary typed columns.

A typed column knows its JSON type when the query is built, so rules that cannot apply vanish from the plan; a VARIANT
column is asked at run time. SQL NULL means *absent*; a JSON null is a value of type ``null``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conform.functions import numbers as N


def quoted_step(key: str) -> str | None:
    """A JSONPath for one key; None where the path grammar has no way to write it."""
    return None if '"' in key or "]" in key or "\\" in key else f'$["{key}"]'


class VariantNode:
    """A value inside a VARIANT.

    Columns made from it are kept: keywords and schemas that ask the same of one value share them, and building one takes many calls of the JVM.
    """

    def __init__(self, value: Column) -> None:
        self.value = value
        self._made: dict[Any, Any] = {}

    def _once(self, name: Any, make: Callable[[], Any]) -> Any:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @cached_property
    def kind(self) -> Column:
        return F.schema_of_variant(self.value)

    @cached_property
    def is_long(self) -> Column:
        return self.kind == "BIGINT"

    @cached_property
    def long(self) -> Column:
        return F.try_variant_get(self.value, "$", "bigint")

    @cached_property
    def form(self) -> Column:
        """The normal form of a number."""
        return N.normal_form(self.text())

    @cached_property
    def parts(self) -> Column:
        return N.literal_parts(self.text())

    def present(self) -> Column:
        return self._once("present", self.value.isNotNull)

    def is_type(self, name: str) -> Column:
        return self._once(("type", name), lambda: self._is_type(name))

    def _is_type(self, name: str) -> Column:
        k = self.kind
        if name == "null":
            return k == "VOID"
        if name == "boolean":
            return k == "BOOLEAN"
        if name == "string":
            return k.isin("STRING", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY")
        if name in ("array", "object"):  # one level is looked at; the kind's text names all below
            return F.try_variant_get(self.value, "$", "array<variant>" if name == "array" else "map<string,variant>").isNotNull()
        number = k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
        if name == "number":
            return number
        if name == "integer":
            whole = self.number()
            return self.is_long | (number & (whole == F.floor(whole)))
        return F.lit(False)

    def number(self) -> Column:
        return self._once("number", lambda: F.try_variant_get(self.value, "$", "double"))

    def text(self) -> Column:
        return self._once("text", lambda: F.try_variant_get(self.value, "$", "string"))

    def compared(self, operator: str, limit: object) -> Column:
        """``value operator limit`` as the literals say it; whole numbers are compared as longs."""
        return F.when(self.is_long, N.against_long(self.long, operator, limit)).otherwise(N.against_form(self.form, operator, limit))

    def among(self, numbers: list) -> Column:
        """Whether the value is one of some numbers, whatever their literals."""
        longs = _longs(numbers)
        return F.when(self.is_long, self.long.isin(*longs) if longs else F.lit(False)).otherwise(self.form.isin(*[N.form_of(x) for x in numbers]))

    def multiple_of(self, step: object) -> Column:
        exact = N.is_multiple(self.parts, step)
        d = N.exact(step)
        if d == int(d) and d < N.LONG:
            return F.when(self.is_long, self.long % F.lit(int(d)).cast("bigint") == 0).otherwise(exact)
        return exact

    def canonical(self) -> Column:
        """JSON text in which equal values are equal: keys in order, 1.0 and 1e0 as 1, strings in quotes. Inside of arrays and objects an exponent below -3 or above 6 stays."""
        return self._once("canonical", self._canonical)

    def _canonical(self) -> Column:
        text = F.to_json(self.value)
        plain = F.when(text.rlike(r"\d\.0(?![\dE])"), F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<=\d)\.0(?![\dE])', "$1")).otherwise(text)
        return F.when(self.kind == "DOUBLE", _plain_double(self.number())).when(self.kind.startswith("ARRAY") | self.kind.startswith("OBJECT"), plain).otherwise(text)

    def get(self, key: str) -> VariantNode:
        return self._once(("key", key), lambda: self._get(key))

    def _get(self, key: str) -> VariantNode:
        step = quoted_step(key)
        if step is None:
            return VariantNode(F.try_element_at(self.entries_map(), F.lit(key)))
        return VariantNode(F.try_variant_get(self.value, step, "variant"))

    def entries_map(self) -> Column:
        return self._once("entries", lambda: F.try_variant_get(self.value, "$", "map<string,variant>"))

    def keys(self) -> Column:
        return self._once("keys", lambda: F.map_keys(self.entries_map()))

    def items(self) -> Column:
        return self._once("items", lambda: F.try_variant_get(self.value, "$", "array<variant>"))

    def over_items(self, form: Callable[[VariantNode, Column], Column], start: int = 0) -> Column:
        """``form(item, position)`` of every item from ``start``, as an array."""
        return F.transform(self.items() if not start else F.slice(self.items(), start + 1, F.greatest(F.size(self.items()) - start, F.lit(0))), lambda x, i: form(VariantNode(x), i + start))

    def over_entries(self, form: Callable[[Column, VariantNode], Column]) -> Column:
        """``form(key, value)`` of every property, as an array."""
        return F.transform(F.map_entries(self.entries_map()), lambda e: form(e["key"], VariantNode(e["value"])))

    def never(self, name: str) -> bool:
        """Whether the value is known not to be of that type."""
        return False


class TypedNode:
    """An ordinary column; a null field counts as absent, as in ``to_json``."""

    def __init__(self, value: Column, dtype: T.DataType) -> None:
        self.value, self.dtype = value, dtype
        self.json_type = json_type(dtype)

    def present(self) -> Column:
        return self.value.isNotNull()

    def never(self, name: str) -> bool:
        return not (name == self.json_type or {name, self.json_type} == {"integer", "number"})

    def is_type(self, name: str) -> Column:
        if name == "integer" and self.json_type == "number":
            return self.value == F.floor(self.value)
        return F.lit(name == self.json_type or (name == "number" and self.json_type == "integer"))

    def number(self) -> Column:
        return self.value.cast("double")

    def compared(self, operator: str, limit: object) -> Column:
        """``value operator limit`` as the literals say it."""
        if isinstance(self.dtype, T.IntegralType):
            return N.against_long(self.value.cast("bigint"), operator, limit)
        if isinstance(self.dtype, (T.DoubleType, T.FloatType)) and N.same_as_double(limit):
            x, at = self.number() if isinstance(self.dtype, T.DoubleType) else self.value.cast("string").cast("double"), F.lit(float(limit))
            return N.COMPARE[operator](x, at)
        return N.against_form(N.normal_form(self.value.cast("string")), operator, limit)

    def among(self, numbers: list) -> Column:
        if isinstance(self.dtype, T.IntegralType):
            return self.value.cast("bigint").isin(*longs) if (longs := _longs(numbers)) else F.lit(False)
        return N.normal_form(self.value.cast("string")).isin(*[N.form_of(x) for x in numbers])

    def multiple_of(self, step: object) -> Column:
        exact, d = N.is_multiple(N.literal_parts(self.value.cast("string")), step), N.exact(step)
        if isinstance(self.dtype, T.IntegralType) and d == int(d) and d < N.LONG:
            return self.value.cast("bigint") % F.lit(int(d)).cast("bigint") == 0
        if d.as_tuple().exponent >= -10 and d < 10**17:  # few digits: the rest of a decimal, where that holds the whole number
            few = self.decimal()
            holds = (few.cast("double") == self.number()) & (F.abs(self.number()) < 1e17) if not isinstance(self.dtype, T.DecimalType) else F.lit(self.dtype.scale <= 10) & (F.abs(self.number()) < 1e17)
            return F.when(holds, F.try_mod(few, F.lit(str(d)).cast("decimal(38,10)")) == 0).otherwise(exact)
        return exact

    def decimal(self) -> Column:
        return self.value.cast("decimal(38,10)") if isinstance(self.dtype, (T.IntegralType, T.DecimalType)) else self.value.try_cast("decimal(38,10)")

    def text(self) -> Column:
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(self.value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return self.value.cast("string")

    def canonical(self) -> Column:
        if self.json_type in ("object", "array"):
            return F.to_json(self.value) if self.json_type == "object" else F.to_json(F.to_variant_object(self.value))
        if self.json_type == "string":
            return F.concat(F.lit('"'), F.replace(F.replace(self.text(), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        if self.json_type == "boolean":
            return self.value.cast("string")
        if isinstance(self.dtype, T.IntegralType):
            return self.value.cast("string")
        if isinstance(self.dtype, T.DecimalType):
            return _stripped(self.value.cast("string"))
        return _plain_double(self.number())

    def get(self, key: str) -> TypedNode | None:
        for f in getattr(self.dtype, "fields", []):
            if f.name == key:
                return TypedNode(self.value[key], f.dataType)
        if isinstance(self.dtype, T.MapType):
            return TypedNode(F.try_element_at(self.value, F.lit(key)), self.dtype.valueType)
        return None

    def entries_map(self) -> Column:
        return self.value

    def keys(self) -> Column:
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.value)
        return F.array_compact(F.array(*[F.when(self.value[f.name].isNotNull(), F.lit(f.name)) for f in self.dtype.fields]))

    def items(self) -> Column:
        return self.value

    def over_items(self, form: Callable[[TypedNode, Column], Column], start: int = 0) -> Column:
        kind = self.dtype.elementType
        source = self.value if not start else F.slice(self.value, start + 1, F.greatest(F.size(self.value) - start, F.lit(0)))
        return F.transform(source, lambda x, i: form(TypedNode(x, kind), i + start))

    def over_entries(self, form: Callable[[Column, TypedNode], Column]) -> Column:
        if isinstance(self.dtype, T.MapType):
            return F.transform(F.map_entries(self.value), lambda e: form(e["key"], TypedNode(e["value"], self.dtype.valueType)))
        return F.array(*[F.when(self.value[f.name].isNotNull(), form(F.lit(f.name), TypedNode(self.value[f.name], f.dataType))) for f in self.dtype.fields])


def _longs(numbers: list) -> list[int]:
    exact = [N.exact(x) for x in numbers]
    return [int(d) for d in exact if d == int(d) and -N.LONG <= int(d) < N.LONG]


def _stripped(text: Column) -> Column:
    """A decimal's text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _plain_double(x: Column) -> Column:
    """A double's text as a whole number or decimal would have it, where 20 digits before and 18 after the point hold it."""
    plain = x.try_cast("decimal(38,18)")
    return F.when(plain.cast("double") == x, _stripped(plain.cast("string"))).otherwise(x.cast("string"))


def json_type(dtype: T.DataType) -> str:
    """The JSON type of a Spark type."""
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "string"


def value_at(value: Column, pointer: Column) -> Column:
    """The value at a JSON pointer inside a VARIANT; null if there is none."""
    key = lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    member = lambda v, s: F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), key(s))
    item = lambda v, s: F.get(F.try_variant_get(v, "$", "array<variant>"), s.try_cast("int"))
    steps = F.slice(F.split(pointer, "/"), F.lit(2), F.greatest(F.size(F.split(pointer, "/")) - 1, F.lit(0)))
    return F.aggregate(steps, value, lambda v, s: F.coalesce(member(v, s), item(v, s)))
