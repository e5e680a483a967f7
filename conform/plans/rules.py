"""JSON Schema to native expressions: every keyword becomes part of one array of violations, in one scan and without a shuffle.

A schema is small and known when the query is built; the documents are not. So the schema is walked here once, and what is left
for the executors are column expressions over the documents' values: conditions, higher-order functions over
items and properties, and counts of branch errors for combinators. References are followed as they are met, as long as the expression stays small (``BUDGET``
schema objects). Where it would not, because schemas refer back to themselves or share definitions, the expression stops at references and names what it
would need: pairs of a value and a *place*, the schema that the reference leads to. Each place is compiled once, so the plan grows with
the schema and not with its paths; :mod:`conform.operators.fixpoint` visits the pairs and hands their outcomes back.

The draft that ``$schema`` names decides which keywords count: before 2019-09 nothing counts beside ``$ref``, and in draft 4 ``exclusiveMinimum`` is a flag.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from conform.functions.formats import check_format
from conform.functions.numbers import exact, let
from conform.functions.regexes import java_regex
from conform.functions.values import TypedNode, VariantNode

VIOLATION = "struct<instance_path:string,schema_path:string,kind:string,message:string,params:map<string,string>>"
#: Keywords registered by users: name -> (value node, parameter) -> Column that is true for a valid value.
CUSTOM: dict[str, tuple[Callable[[Any, Any], Column], str]] = {}


def register_rule(name: str, check: Callable[[Any, Any], Column], message: str) -> None:
    """Add a keyword of one's own; its violations have the kind ``custom`` and the message."""
    CUSTOM[name] = (check, message)


#: References on the way to a value: (the schema that each leads to, how deep in the document it was met).
Trail = tuple[tuple[int, int], ...]


class UnresolvedReference(ValueError):
    """A reference that leads nowhere."""


#: Schema objects that one expression may hold before it stops at references, and how often it follows one that comes again where that fits.
BUDGET, UNROLL = 96, 6
#: What an expression needs to know of deeper values: the reference's place and the value's pointer, from the value that was asked about.
NEED = "struct<place:string,path:string>"
#: The kind of a row that stands for the violations of another pair.
PENDING = "pending"
_LATER = {"const": 6, "contains": 6, "propertyNames": 6, "if": 7, "then": 7, "else": 7, "contentEncoding": 7, "contentMediaType": 7, "dependentRequired": 8, "dependentSchemas": 8, "unevaluatedItems": 8, "unevaluatedProperties": 8, "minContains": 8, "maxContains": 8, "prefixItems": 9}
_DRAFTS = (("draft-04", 4), ("draft-06", 6), ("draft-07", 7), ("2019-09", 8), ("2020-12", 9))


def draft_of(root: Any) -> int:
    """The draft of a schema: 4, 6, 7, 8 for 2019-09, 9 for 2020-12, which also counts where none is named."""
    named = root.get("$schema") if isinstance(root, dict) else None
    return next((n for part, n in _DRAFTS if part in named), 9) if isinstance(named, str) else 9


def effective(schema: dict, root: Any) -> dict:
    """The keywords of a schema that its draft knows."""
    draft = draft_of(root)
    if draft == 9:
        return schema
    if draft <= 7 and isinstance(schema.get("$ref"), str):
        return {"$ref": schema["$ref"]}
    out = {k: v for k, v in schema.items() if _LATER.get(k, 0) <= draft}
    if draft == 4:
        for flag, bound in (("exclusiveMinimum", "minimum"), ("exclusiveMaximum", "maximum")):
            if out.pop(flag, None) is True and bound in out:
                out[flag] = out.pop(bound)
        if isinstance(out.get("id"), str):
            out["$id"] = out["id"]
    return out


@dataclass
class Compiler:
    """Turns schemas of a store (``uri -> parsed schema``) into expressions."""

    store: Mapping[str, Any] = field(default_factory=dict)
    formats: bool = True
    budget: int = BUDGET
    #: Places at which expressions stop: name -> (schema, base, root, rank among places that meet on one value).
    places: dict[str, tuple[Any, str, Any, int]] = field(default_factory=dict)
    #: Conditions of the rows that a schema finds fault with; None if there are more than plain conditions.
    plain: list[Column] | None = None

    def __post_init__(self) -> None:
        self._cut: set[int] = set()
        self._names: dict[int, str] = {}
        self._unroll: int | None = None
        self._gathering: list[Column] | None = None
        self._bad: Column | None = None
        self._aside = 0
        self._stops = 0

    def compile(self, schema: Any, node: Any, base: str = "", root: Any = None, bad: Column | None = None) -> Column:
        """All violations of one value: ``array<struct<instance_path, schema_path, kind, message, params>>``.

        ``bad`` holds the needs, as texts ``place path``, whose pairs have violations; without it such references count as fulfilled.
        """
        root = schema if root is None else root
        self._plan(schema, base, root, node)
        self._bad, self._gathering, self.plain, self._aside, self._stops = bad, None, [], 0, 0
        return _joined(self._walk(schema, node, F.lit(""), "", base, root, ((id(schema), 0),)))

    def needs(self, schema: Any, node: Any, base: str = "", root: Any = None) -> Column | None:
        """The pairs, ``array<struct<place, path>>``, on which the violations of a value may depend; None if the expression never stops."""
        root = schema if root is None else root
        self._plan(schema, base, root, node)
        if not self._cut and self._unroll is None:
            return None
        self._bad, self._gathering, self._aside, self._stops = None, [], 1, 0
        parts = [*self._walk(schema, node, F.lit(""), "", base, root, ((id(schema), 0),)), *self._gathering]
        self._gathering = None
        return F.concat(*[F.coalesce(p, F.array().cast(f"array<{NEED}>")) for p in parts]) if self._stops else None

    # -- where expressions stop --------------------------------------------

    def _plan(self, schema: Any, base: str, root: Any, node: Any) -> None:
        """Choose how far references are followed: as often as the budget allows, else only up to places that come again, else up to those that are shared."""
        self._cut, self._unroll = set(), None
        if not isinstance(node, VariantNode) or id(schema) in self._whole:
            return
        targets = self._targets(schema, base, root)
        again = {i for i, t in targets.items() if i in self._reach(i, targets, False)}
        for unroll in range(UNROLL, 0, -1):
            if self._size(schema, base, root, set(), unroll) <= self.budget:
                if again:
                    self._unroll = unroll
                    self._register({i: targets[i] for i in again}, targets)
                else:
                    self._whole.add(id(schema))
                return
            if not again:
                break
        self._cut = again
        if max((self._size(*targets[i][0], again, 1) for i in (id(schema), *again)), default=0) > self.budget:
            self._cut = {i for i, (_, uses, _) in targets.items() if uses > 1 or i in again}
        self._cut -= {i for i in self._cut if i in self._reach(i, targets, True)}  # a reference that comes back to the same value says nothing new
        self._register({i: targets[i] for i in self._cut}, targets)

    def _register(self, places: dict[int, Any], targets: dict[int, Any]) -> None:
        for i, ((schema, base, root), _, _) in places.items():
            if i not in self._names:
                self._names[i] = f"{len(self._names)}:{base}"
                ranks: dict[int, int] = {}
                self.places[self._names[i]] = (schema, base, root, self._rank(i, targets, ranks, ()))

    def _rank(self, i: int, targets: dict[int, Any], ranks: dict[int, int], above: tuple[int, ...]) -> int:
        """How many references a place may still follow on the same value; places are visited by falling rank."""
        if i in above:
            return 0
        if i not in ranks:
            ranks[i] = max((1 + self._rank(j, targets, ranks, (*above, i)) for j, same in targets[i][2] if same), default=0)
        return ranks[i]

    @property
    def _whole(self) -> set[int]:
        return self.__dict__.setdefault("_whole_", set())

    def _reach(self, start: int, targets: dict[int, Any], same_only: bool) -> set[int]:
        seen: set[int] = set()
        open_ = [start]
        while open_:
            for j, same in targets[open_.pop()][2]:
                if j not in seen and (same or not same_only):
                    seen.add(j)
                    open_.append(j)
        return seen

    def _parts(self, schema: Any, base: str, root: Any) -> Iterator[tuple[Any, str, bool]]:
        """The schemas inside a schema, with their base and whether they hold for the same value."""
        if not isinstance(schema, dict):
            return
        schema = effective(schema, root)
        if isinstance(schema.get("$id"), str) and not schema["$id"].startswith("#"):
            base = urljoin(base, schema["$id"])
        for key, value in schema.items():
            if key in ("allOf", "anyOf", "oneOf") and isinstance(value, list):
                yield from ((v, base, True) for v in value)
            elif key in ("not", "if", "then", "else"):
                yield value, base, True
            elif key in ("dependentSchemas", "dependencies") and isinstance(value, dict):
                yield from ((v, base, True) for v in value.values() if not isinstance(v, list))
            elif key in ("properties", "patternProperties") and isinstance(value, dict):
                yield from ((v, base, False) for v in value.values())
            elif key in ("prefixItems", "items") and isinstance(value, list):
                yield from ((v, base, False) for v in value)
            elif key in ("items", "additionalItems", "additionalProperties", "contains", "propertyNames", "unevaluatedItems", "unevaluatedProperties"):
                yield value, base, False

    def _refs(self, schema: Any, base: str, root: Any) -> Iterator[tuple[tuple[Any, str, Any], bool]]:
        """The references that a schema's own text makes: what each leads to, and whether for the same value."""
        if not isinstance(schema, dict):
            return
        known = effective(schema, root)
        inner = urljoin(base, known["$id"]) if isinstance(known.get("$id"), str) and not known["$id"].startswith("#") else base
        ref = known.get("$ref", known.get("$dynamicRef"))
        if isinstance(ref, str):
            yield self._resolve(ref, inner, root), True
        for child, at, same in self._parts(schema, base, root):
            yield from ((t, s and same) for t, s in self._refs(child, at, root))

    def _targets(self, schema: Any, base: str, root: Any) -> dict[int, tuple[tuple[Any, str, Any], int, list[tuple[int, bool]]]]:
        """All schemas that references reach from a schema, itself included: id -> (what it is, how often it is referred to, what it refers to)."""
        out: dict[int, Any] = {}
        uses: dict[int, int] = {}
        open_ = [(schema, base, root)]
        while open_:
            at = open_.pop()
            if id(at[0]) in out:
                continue
            found = list(self._refs(*at))
            out[id(at[0])] = (at, found)
            for t, _ in found:
                uses[id(t[0])] = uses.get(id(t[0]), 0) + 1
            open_ += [t for t, _ in found]
        return {i: (at, uses.get(i, 0), list({(id(t[0]), same) for t, same in found})) for i, (at, found) in out.items()}

    def _size(self, schema: Any, base: str, root: Any, cut: set[int], unroll: int) -> int:
        """Schema objects that an expression would hold; counting ends beyond the budget."""
        count = 0

        def walk(schema: Any, base: str, root: Any, trail: tuple[tuple[int, int], ...], level: int) -> None:
            nonlocal count
            count += 1
            if count > self.budget or not isinstance(schema, dict):
                return
            known = effective(schema, root)
            inner = urljoin(base, known["$id"]) if isinstance(known.get("$id"), str) and not known["$id"].startswith("#") else base
            ref = known.get("$ref", known.get("$dynamicRef"))
            if isinstance(ref, str):
                target, new_base, new_root = self._resolve(ref, inner, root)
                met = [d for i, d in trail if i == id(target)]
                if level not in met and id(target) not in cut and len(met) < unroll + 1:
                    walk(target, new_base, new_root, (*trail, (id(target), level)), level)
            again = bool({"unevaluatedItems", "unevaluatedProperties"} & set(known))
            for child, at, same in self._parts(schema, base, root):
                for _ in range(2 if same and again else 1):  # branches are asked once more which values they speak of
                    walk(child, at, root, trail, level if same else level + 1)

        walk(schema, base, root, ((id(schema), 0),), 0)
        return count

    # -- helpers -----------------------------------------------------------

    def _resolve(self, ref: str, base: str, root: Any) -> tuple[Any, str, Any]:
        uri, fragment = urldefrag(urljoin(base, ref) if not ref.startswith("#") else ref)
        target_root, target_base = (root, base) if not uri or uri == urldefrag(base)[0] else (self.store.get(uri), uri)
        if target_root is None:
            raise UnresolvedReference(ref)
        at = target_root
        if fragment and not fragment.startswith("/"):
            found = _find_anchor(target_root, fragment)
            if found is None:
                raise UnresolvedReference(ref)
            return found, target_base, target_root
        for step in [unquote(s).replace("~1", "/").replace("~0", "~") for s in fragment.split("/")[1:]]:
            if isinstance(at, list) and step.isdigit() and int(step) < len(at):
                at = at[int(step)]
            elif isinstance(at, dict) and step in at:
                at = at[step]
            else:
                raise UnresolvedReference(ref)
        return at, target_base, target_root

    def _walk(self, schema: Any, node: Any, path: Column, at: str, base: str, root: Any, trail: Trail = (), level: int = 0) -> list[Column]:
        """Arrays of violations, or of needs while those are gathered. Every one is empty or null where the value is absent."""
        if schema is True or schema == {}:
            return []
        if schema is False:
            if self._gathering is not None:
                return []
            if self.plain is not None and not self._aside:
                self.plain.append(node.present())
            return [F.array_compact(F.array(_violation(node.present(), path, at, "false_schema", "False schema does not allow any value", {})))]
        if not isinstance(schema, dict):
            return []
        schema = effective(schema, root)
        if isinstance(schema.get("$id"), str) and not schema["$id"].startswith("#"):
            base = urljoin(base, schema["$id"])
        simple: list[Column] = []
        nested: list[Column] = []

        def bad(when: Column, where: str, kind: str, message: str | Column, /, **params: Any) -> None:
            if self._gathering is not None:
                return
            if self.plain is not None and not self._aside:
                self.plain.append(node.present() & when)
            simple.append(_violation(node.present() & when, path, f"{at}/{where}", kind, message, params))

        def sub(child: Any, to: Any, where: Column, step: str) -> Column:
            return self._all(self._walk(child, to, where, f"{at}/{step}", base, root, trail, level + (to is not node)))

        ref = schema.get("$ref", schema.get("$dynamicRef"))
        if isinstance(ref, str):
            nested += self._reference(ref, node, path, at, base, root, trail, level)
        if self._gathering is None:
            self._any_type(schema, node, bad)
            if not node.never("string"):
                self._strings(schema, node, bad)
            if not node.never("number"):
                self._numbers(schema, node, bad)
        if not node.never("array"):
            self._arrays(schema, node, path, bad, sub, nested)
        if not node.never("object"):
            self._objects(schema, node, path, at, base, root, bad, sub, nested, simple)
        self._combinators(schema, node, path, at, bad, sub, nested)
        self._unevaluated(schema, node, path, at, base, root, sub, trail, level, nested)
        for name, (check, message) in CUSTOM.items():
            if name in schema:
                bad(~check(node, schema[name]), name, "custom", message, keyword=name)
        return ([F.array_compact(F.array(*simple))] if simple else []) + nested

    def _all(self, parts: list[Column]) -> Column:
        return _joined(parts) if self._gathering is None else F.concat(*[F.coalesce(p, F.array().cast(f"array<{NEED}>")) for p in parts]) if parts else F.array().cast(f"array<{NEED}>")

    def _none(self) -> Column:
        return F.array().cast(f"array<{VIOLATION if self._gathering is None else NEED}>")

    @contextmanager
    def _within(self, branch: bool) -> Iterator[None]:
        """Inside of items, properties or branches, where a condition is none of the row's own; violations there make more than plain conditions."""
        if not branch and not self._aside:
            self.plain = None
        self._aside += 1
        yield
        self._aside -= 1

    def _reference(self, ref: str, node: Any, path: Column, at: str, base: str, root: Any, trail: Trail, level: int) -> list[Column]:
        target, new_base, new_root = self._resolve(ref, base, root)
        met = [depth for known, depth in trail if known == id(target)]
        if level in met:
            return []  # met again on the same value: it says nothing new
        stops = isinstance(node, VariantNode) and (id(target) in self._cut or (self._unroll is not None and len(met) > self._unroll))
        if stops and id(target) in self._names:
            name = self._names[id(target)]
            self._stops += 1
            if self._gathering is not None:
                return [F.when(node.present(), F.array(F.struct(F.lit(name).alias("place"), path.alias("path"))))]
            if self._bad is None:
                return []
            failed = F.array_contains(self._bad, F.concat(F.lit(f"{name} "), path))
            return [F.array_compact(F.array(_violation(node.present() & failed, path, f"{at}/$ref", PENDING, name, {})))]
        return self._walk(target, node, path, f"{at}/$ref", new_base, new_root, (*trail, (id(target), level)), level)

    def property_names(self, schema: Any, base: str, root: Any, seen: tuple[int, ...] = ()) -> list[str]:
        """The properties that a schema declares, through its reference and ``allOf``."""
        if isinstance(schema, dict) and isinstance(schema.get("$ref"), str):
            schema, base, root = self._resolve(schema["$ref"], base, root)
        if not isinstance(schema, dict) or id(schema) in seen:
            return []
        own = list(schema["properties"]) if isinstance(schema.get("properties"), dict) else []
        return own + [name for child in schema.get("allOf", []) for name in self.property_names(child, base, root, (*seen, id(schema)))]

    def ok(self, child: Any, node: Any, path: Column, base: str, root: Any, trail: Trail, level: int) -> Column:
        with self._within(True):
            found = self._walk(child, node, path, "", base, root, trail, level)
        if self._gathering is not None:
            self._gathering += found
            return F.lit(True)
        return F.size(_joined(found)) == 0

    # -- keywords ----------------------------------------------------------

    def _any_type(self, schema: dict, node: Any, bad: Callable) -> None:
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            fits = F.lit(False)
            for n in names:
                fits = fits | node.is_type(n)
            expected = ", ".join(names)
            bad(~fits, "type", "type", f'value is not of type "{expected}"', expected=expected)
        if "enum" in schema:
            options = [_text(x) for x in schema["enum"]]
            bad(~_is_one_of(node, schema["enum"]), "enum", "enum", "value is not one of: " + ", ".join(options), options=_text(schema["enum"]))
        if "const" in schema:
            bad(~_is_one_of(node, [schema["const"]]), "const", "constant", f"{_text(schema['const'])} was expected", expected_value=_text(schema["const"]))

    def _numbers(self, schema: dict, node: Any, bad: Callable) -> None:
        if not {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"} & set(schema):
            return
        is_number = node.is_type("number")
        for keyword, kind, operator, words in (
            ("minimum", "minimum", "<", "value is less than the minimum of"),
            ("maximum", "maximum", ">", "value is greater than the maximum of"),
            ("exclusiveMinimum", "exclusive_minimum", "<=", "value is less than or equal to the minimum of"),
            ("exclusiveMaximum", "exclusive_maximum", ">=", "value is greater than or equal to the maximum of"),
        ):
            limit = schema.get(keyword)
            if _is_number(limit):
                bad(is_number & node.compared(operator, limit), keyword, kind, f"{words} {_text(limit)}", limit=_text(limit))
        step = schema.get("multipleOf")
        if _is_number(step) and step > 0:
            bad(is_number & ~node.multiple_of(step), "multipleOf", "multiple_of", f"value is not a multiple of {_text(step)}", multiple_of=_text(step))

    def _strings(self, schema: dict, node: Any, bad: Callable) -> None:
        if not {"minLength", "maxLength", "pattern", "format", "contentEncoding", "contentMediaType"} & set(schema):
            return
        text, is_text = node.text(), node.is_type("string")
        if "minLength" in schema:
            n = int(schema["minLength"])
            bad(is_text & (F.length(text) < n), "minLength", "min_length", f"string is shorter than {n} character{'' if n == 1 else 's'}", limit=n)
        if "maxLength" in schema:
            n = int(schema["maxLength"])
            bad(is_text & (F.length(text) > n), "maxLength", "max_length", f"string is longer than {n} character{'' if n == 1 else 's'}", limit=n)
        if "pattern" in schema:
            bad(is_text & ~text.rlike(java_regex(schema["pattern"])), "pattern", "pattern", f'value does not match "{schema["pattern"]}"', pattern=schema["pattern"])
        if self.formats and isinstance(schema.get("format"), str) and (fine := check_format(schema["format"], text)) is not None:
            bad(is_text & ~fine, "format", "format", f'value is not a "{schema["format"]}"', format=schema["format"])
        plain = text
        if schema.get("contentEncoding") == "base64":
            plain = F.try_to_binary(text, F.lit("base64"))
            bad(is_text & plain.isNull(), "contentEncoding", "content_encoding", 'not compliant with "base64" content encoding', content_encoding="base64")
            plain = F.try_validate_utf8(plain.cast("string"))
        if schema.get("contentMediaType") == "application/json":
            bad(is_text & plain.isNotNull() & F.try_parse_json(plain).isNull(), "contentMediaType", "content_media_type", 'not compliant with "application/json" media type', content_media_type="application/json")

    def _arrays(self, schema: dict, node: Any, path: Column, bad: Callable, sub: Callable, nested: list[Column]) -> None:
        if not {"minItems", "maxItems", "uniqueItems", "contains", "prefixItems", "items", "additionalItems"} & set(schema):
            return
        items, is_array = node.items(), node.is_type("array")
        for keyword, kind, fails, words in (("minItems", "min_items", lambda n, m: n < m, "array has less than"), ("maxItems", "max_items", lambda n, m: n > m, "array has more than")):
            if keyword in schema:
                n = int(schema[keyword])
                bad(is_array & fails(F.size(items), n), keyword, kind, f"{words} {n} item{'' if n == 1 else 's'}", limit=n)
        if schema.get("uniqueItems") is True:
            texts = node.over_items(lambda x, _: x.canonical())
            bad(is_array & (F.size(F.array_distinct(texts)) < F.size(texts)), "uniqueItems", "unique_items", "array has non-unique elements")
        if "contains" in schema:
            with self._within(True):
                inside = node.over_items(lambda x, i: sub(schema["contains"], x, F.concat(path, F.lit("/"), i.cast("string")), "contains"))
            if self._gathering is not None:
                nested.append(F.flatten(inside))
            n = F.size(F.filter(inside, lambda x: F.size(x) == 0))
            least, most = int(schema.get("minContains", 1)), schema.get("maxContains")
            bad(is_array & ((n < least) | (n > int(most) if most is not None else F.lit(False))), "contains", "contains", "None of the items are valid under the given schema")
        prefix = schema.get("prefixItems")
        rest, word = schema.get("items"), "items"
        if isinstance(rest, list):
            prefix, rest, word = rest, schema.get("additionalItems"), "additionalItems"
        prefix = prefix or []
        for i, child in enumerate(prefix):
            step = f"prefixItems/{i}" if "prefixItems" in schema else f"items/{i}"
            part = F.slice(items, i + 1, 1)
            make = (lambda x: VariantNode(x)) if isinstance(node, VariantNode) else (lambda x: TypedNode(x, node.dtype.elementType))
            with self._within(False):
                nested.append(F.flatten(F.transform(part, lambda x: sub(child, make(x), F.concat(path, F.lit(f"/{i}")), step))))
        if rest is False and word == "additionalItems":
            bad(is_array & (F.size(items) > len(prefix)), word, "additional_items", f"Additional items are not allowed (limit: {len(prefix)})", limit=len(prefix))
        elif rest is not None and rest is not True:
            with self._within(False):
                nested.append(F.flatten(node.over_items(lambda x, i: sub(rest, x, F.concat(path, F.lit("/"), i.cast("string")), word), len(prefix))))

    def _objects(self, schema: dict, node: Any, path: Column, at: str, base: str, root: Any, bad: Callable, sub: Callable, nested: list[Column], simple: list[Column]) -> None:
        wanted = {"properties", "patternProperties", "additionalProperties", "required", "propertyNames", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "dependencies"}
        if not wanted & set(schema):
            return
        is_object = node.is_type("object")
        has = lambda k: F.lit(False) if (child := node.get(k)) is None else child.present()
        for key in schema.get("required", []) if isinstance(schema.get("required"), list) else []:
            bad(is_object & ~has(key), "required", "required", f'"{key}" is a required property', property=f'"{key}"')
        for keyword, kind, fails, words in (("minProperties", "min_properties", lambda n, m: n < m, "object has less than"), ("maxProperties", "max_properties", lambda n, m: n > m, "object has more than")):
            if keyword in schema:
                n = int(schema[keyword])
                bad(is_object & fails(F.size(node.keys()), n), keyword, kind, f"{words} {n} propert{'y' if n == 1 else 'ies'}", limit=n)
        needs = {k: v for k, v in {**schema.get("dependencies", {}), **schema.get("dependentRequired", {})}.items() if isinstance(v, list)}
        for key, others in needs.items():
            for other in others:
                bad(is_object & has(key) & ~has(other), "dependentRequired", "required", f'"{other}" is a required property', property=f'"{other}"')
        for key, child in {**{k: v for k, v in schema.get("dependencies", {}).items() if not isinstance(v, list)}, **schema.get("dependentSchemas", {})}.items():
            with self._within(False):
                nested.append(F.when(is_object & has(key), sub(child, node, path, f"dependentSchemas/{_escape(key)}")))
        declared = schema.get("properties", {}) if isinstance(schema.get("properties"), dict) else {}
        for key, child in declared.items():
            value = node.get(key)
            if value is not None:
                at_key = lambda v, k=key, c=child: F.when(v.present(), sub(c, v, F.concat(path, F.lit(f"/{_escape(k)}")), f"properties/{_escape(k)}"))
                if child in (True, {}):
                    nested.append(self._none())
                elif isinstance(value, VariantNode) and self._gathering is None:  # what branches need is gathered outside, where no variable reaches
                    with self._within(False):  # taken out of the object once, however many rules ask for it
                        nested.append(let(value.value, lambda x: at_key(VariantNode(x))))
                else:
                    nested.append(at_key(value))
        step = lambda k: F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        patterns = schema.get("patternProperties", {}) if isinstance(schema.get("patternProperties"), dict) else {}
        for pattern, child in patterns.items():
            with self._within(False):
                nested.append(F.flatten(F.array_compact(node.over_entries(lambda k, v: F.when(k.rlike(java_regex(pattern)), sub(child, v, step(k), f"patternProperties/{_escape(pattern)}"))))))
        if "propertyNames" in schema and self._gathering is None:
            names = schema["propertyNames"]
            with self._within(False):
                nested.append(
                    F.array_compact(F.transform(node.keys(), lambda k: _violation(F.size(sub(names, _KeyNode(k), F.lit(""), "propertyNames")) > 0, path, f"{at}/propertyNames", "property_names", None, {}, F.concat(F.lit('"'), k, F.lit('" is not a valid property name')))))
                )
        extra = schema.get("additionalProperties")
        if extra is not None and extra is not True and extra != {}:
            other = lambda k: ~_listed(k, list(declared), list(patterns))
            if extra is False and self._gathering is None:
                self.plain = self.plain if self._aside else None
                known = list(dict.fromkeys(self.property_names(schema, base, root)))
                said = lambda k: F.concat(F.lit("Additional properties are not allowed ('"), k, F.lit("' was unexpected)"), _hint(k, known))
                nested.append(F.array_compact(F.transform(F.filter(node.keys(), other), lambda k: _violation(F.lit(True), step(k), f"{at}/additionalProperties", "additional_property", None, {"property": k}, said(k)))))
            elif extra is not False:
                with self._within(False):
                    nested.append(F.flatten(F.array_compact(node.over_entries(lambda k, v: F.when(other(k), sub(extra, v, step(k), "additionalProperties"))))))

    def _combinators(self, schema: dict, node: Any, path: Column, at: str, bad: Callable, sub: Callable, nested: list[Column]) -> None:
        for i, child in enumerate(schema.get("allOf", [])):
            nested.append(sub(child, node, path, f"allOf/{i}"))

        def branch(child: Any, word: str) -> Column:
            """Whether a value fits a branch."""
            with self._within(True):
                found = sub(child, node, path, word)
            if self._gathering is not None:
                nested.append(found)
            return F.size(found) == 0

        fits = lambda word: sum((F.when(branch(c, word), 1).otherwise(0) for c in schema[word]), F.lit(0))
        if schema.get("anyOf"):
            bad(fits("anyOf") == 0, "anyOf", "any_of", "not valid under any of the schemas listed in the 'anyOf' keyword")
        if schema.get("oneOf"):
            n = fits("oneOf")
            none, many = "not valid under any of the schemas listed in the 'oneOf' keyword", "valid under more than one of the schemas listed in the 'oneOf' keyword"

            def said(k: Column) -> Column:  # the count stands once in the expression, however often it is looked at
                kind = F.when(k == 0, "one_of_not_valid").otherwise("one_of_multiple_valid")
                return _violation(node.present() & (k != 1), path, f"{at}/oneOf", kind, F.when(k == 0, none).otherwise(many), {})

            if self._gathering is None:
                if self.plain is not None and not self._aside:
                    self.plain.append(node.present() & (n != 1))
                nested.append(F.array_compact(F.transform(F.array(n), said)))
        if "not" in schema:
            bad(branch(schema["not"], "not"), "not", "not", "value should not be valid under the given schema")
        if "if" in schema and ("then" in schema or "else" in schema):
            holds = branch(schema["if"], "if")
            parts = lambda h: [F.when(when if self._gathering is None else F.lit(True), sub(schema[word], node, path, word)) for word, when in (("then", h), ("else", ~h)) if word in schema]
            with self._within(False):
                nested += [F.flatten(F.transform(F.array(holds), lambda h: self._all(parts(h))))] if self._gathering is None else parts(holds)

    # -- unevaluated -------------------------------------------------------

    def _seen(self, schema: Any, node: Any, path: Column, base: str, root: Any, trail: Trail, level: int, items: bool, when: Column | None = None, above: tuple[int, ...] = ()) -> list[tuple[Column | None, Any]]:
        """What a schema and its branches evaluate: (condition, names and patterns or a count of items; None for all)."""
        if not isinstance(schema, dict) or id(schema) in above:
            return []
        depth, above, schema = len(above), (*above, id(schema)), effective(schema, root)
        out: list[tuple[Column | None, Any]] = []
        if items:
            prefix = schema.get("prefixItems") or (schema["items"] if isinstance(schema.get("items"), list) else [])
            if prefix:
                out.append((when, len(prefix)))
            if ("items" in schema and not isinstance(schema["items"], list)) or "additionalItems" in schema or "unevaluatedItems" in schema and depth:
                out.append((when, None))
        else:
            names, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
            if names or patterns:
                out.append((when, (names, patterns)))
            if "additionalProperties" in schema or "unevaluatedProperties" in schema and depth:
                out.append((when, None))
        both = lambda c: c if when is None else when & c
        again = lambda child, cond: self._seen(child, node, path, base, root, trail, level, items, cond, above)
        ok = lambda child: self.ok(child, node, path, base, root, trail, level)
        if isinstance(schema.get("$ref"), str):
            target, new_base, new_root = self._resolve(schema["$ref"], base, root)
            out += self._seen(target, node, path, new_base, new_root, trail, level, items, when, above)
        for child in schema.get("allOf", []):
            out += again(child, when)
        for word in ("anyOf", "oneOf"):
            for child in schema.get(word, []):
                out += again(child, both(ok(child)))
        if "if" in schema:
            holds = ok(schema["if"])
            out += again(schema["if"], both(holds)) + again(schema.get("then"), both(holds)) + again(schema.get("else"), both(~holds))
        for key, child in schema.get("dependentSchemas", {}).items():
            if (value := node.get(key)) is not None:
                out += again(child, both(value.present()))
        return out

    def _unevaluated(self, schema: dict, node: Any, path: Column, at: str, base: str, root: Any, sub: Callable, trail: Trail, level: int, nested: list[Column]) -> None:
        some = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
        if "unevaluatedProperties" in schema and schema["unevaluatedProperties"] is not True and not node.never("object"):
            seen = self._seen(schema, node, path, base, root, trail, level, False)
            child = schema["unevaluatedProperties"]
            inside = lambda k, v: sub(child, v, F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "unevaluatedProperties")
            if self._gathering is not None and child is not False:
                with self._within(True):
                    self._gathering.append(F.flatten(node.over_entries(inside)))

            def left_over(holds: Column) -> Column:
                """The keys that no branch speaks of; whether each branch holds is worked out once for all keys."""

                def left(k: Column) -> Column:
                    known = F.lit(False)
                    for i, (_, what) in enumerate(seen):
                        known = known | (holds[i] if what is None else holds[i] & _listed(k, *what))
                    return ~known

                if child is False:
                    return F.filter(node.keys(), left)
                return F.array_compact(node.over_entries(lambda k, v: F.when(left(k) & (F.size(inside(k, v)) > 0), k)))

            if self._gathering is None:
                with self._within(True):
                    keys = let(F.array(*[some(when) for when, _ in seen]), left_over)
                nested.append(self._unexpected(node, node.is_type("object"), keys, path, at, "Unevaluated properties", "unevaluatedProperties", "unevaluated_properties"))
        if "unevaluatedItems" in schema and schema["unevaluatedItems"] is not True and not node.never("array"):
            seen = self._seen(schema, node, path, base, root, trail, level, True)
            done = F.lit(0)
            for when, what in seen:
                done = F.greatest(done, F.when(some(when), F.lit(1 << 30 if what is None else what)).otherwise(0))
            contains, child = schema.get("contains"), schema["unevaluatedItems"]
            with self._within(True):
                inside = lambda x, i, inner, word: sub(inner, x, F.concat(path, F.lit("/"), i.cast("string")), word)
                if self._gathering is not None and child is not False:
                    self._gathering.append(F.flatten(node.over_items(lambda x, i: inside(x, i, child, "unevaluatedItems"))))
                if self._gathering is None:
                    wrong = lambda x, i, n: (i >= n) & (F.size(inside(x, i, contains, "contains")) > 0 if contains is not None else F.lit(True)) & (F.lit(True) if child is False else F.size(inside(x, i, child, "unevaluatedItems")) > 0)
                    texts = let(done, lambda n: F.array_compact(node.over_items(lambda x, i: F.when(wrong(x, i, n), x.canonical()))))
            if self._gathering is None:
                nested.append(self._unexpected(node, node.is_type("array"), texts, path, at, "Unevaluated items", "unevaluatedItems", "unevaluated_items"))

    def _unexpected(self, node: Any, applies: Column, left: Column, path: Column, at: str, words: str, keyword: str, kind: str) -> Column:
        if self.plain is not None and not self._aside:
            self.plain.append(node.present() & applies & (F.size(left) > 0))

        def said(x: Column) -> Column:  # what is left stands once in the expression, however often it is looked at
            message = F.concat(F.lit(f"{words} are not allowed ('"), F.array_join(x, "', '"), F.when(F.size(x) == 1, F.lit("' was unexpected)")).otherwise(F.lit("' were unexpected)")))
            return _violation(node.present() & applies & (F.size(x) > 0), path, f"{at}/{keyword}", kind, message, {"unexpected": F.array_join(x, ", ")})

        return F.array_compact(F.transform(F.array(left), said))


class _KeyNode(TypedNode):
    """A property's name as a value."""

    def __init__(self, key: Column) -> None:
        from pyspark.sql.types import StringType

        super().__init__(key, StringType())


def _joined(parts: list[Column]) -> Column:
    """One array of many, nulls left out."""
    empty = F.array().cast(f"array<{VIOLATION}>")
    parts = [F.coalesce(p, empty) for p in parts]
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else empty


def _violation(when: Column, path: Column, at: str, kind: str | Column, message: str | Column | None, params: dict[str, Any], text: Column | None = None) -> Column:
    if not isinstance(kind, Column) and isinstance(message, str) and not any(isinstance(v, Column) for v in params.values()):
        # All but the place is known: one parsed literal instead of a column object for each of its parts, of which a plan of many schemas has very many.
        pairs = ", ".join(f"{_quoted(k)}, {_quoted(str(v))}" for k, v in params.items())
        known = f"named_struct('instance_path', '', 'schema_path', {_quoted(at)}, 'kind', {_quoted(kind)}, 'message', {_quoted(message)}, 'params', {f'map({pairs})' if pairs else 'CAST(map() AS map<string,string>)'})"
        return F.when(when, F.expr(known).withField("instance_path", path))
    said = text if message is None else message if isinstance(message, Column) else F.lit(message)
    pairs = [x for k, v in params.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(str(v)))]
    found = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    row = F.struct(path.alias("instance_path"), F.lit(at).alias("schema_path"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), said.alias("message"), found.alias("params")).cast(VIOLATION)
    return F.when(when, row)


def _quoted(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hint(key: Column, known: list[str]) -> Column:
    """``; did you mean 'x'?`` with the nearest of the known names within three edits that are at most half of the longer name's bytes; the first of equals."""
    if not known:
        return F.lit("")
    low = F.lower(key)
    near = [F.struct(F.levenshtein(low, F.lit(n.lower()), 3).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(known)]
    fits = F.filter(F.array(*near), lambda x: (x["d"] >= 0) & (x["d"] * 2 <= F.greatest(F.octet_length(key), F.octet_length(x["name"]))))
    return F.coalesce(F.concat(F.lit("; did you mean '"), F.array_min(fits)["name"], F.lit("'?")), F.lit(""))


def _listed(key: Column, names: list[str], patterns: list[str]) -> Column:
    known = key.isin(*names) if names else F.lit(False)
    for p in patterns:
        known = known | key.rlike(java_regex(p))
    return known


def _text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=lambda d: int(d) if d == int(d) else float(d))


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _is_one_of(node: Any, options: list[Any]) -> Column:
    """Whether a value equals one of some known ones; numbers are compared as such, whatever their literals."""
    texts = [x for x in options if isinstance(x, str)]
    numbers = [x for x in options if _is_number(x)]
    rest = [x for x in options if not isinstance(x, str) and not _is_number(x)]
    fits = F.lit(False)
    if texts and not node.never("string"):
        fits = fits | (node.is_type("string") & node.text().isin(*texts))
    if numbers and not node.never("number"):
        fits = fits | (node.is_type("number") & node.among(numbers))
    if rest:
        fits = fits | F.coalesce(node.canonical().isin(*[_canonical(x) for x in rest]), F.lit(False))
    return fits


def _canonical(value: Any) -> str:
    """The text that a node's ``canonical`` gives for an equal value."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float, Decimal)):
        text = format(exact(value), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value, ensure_ascii=False)


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _find_anchor(schema: Any, name: str) -> Any:
    if isinstance(schema, dict):
        if name in (schema.get("$anchor"), schema.get("$dynamicAnchor")) or f"#{name}" in (schema.get("id"), schema.get("$id")):
            return schema
        children = schema.values()
    elif isinstance(schema, list):
        children = schema
    else:
        return None
    return next((x for x in (_find_anchor(c, name) for c in children) if x is not None), None)
