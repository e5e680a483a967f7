"""Violations below the reach of one expression: pairs of a value and a place in a schema, visited once each.

Most documents are done in one scan. Where an expression stops at references (see :mod:`conform.plans.rules`), the pairs that it needs are followed from values down
to deeper ones: every level of the documents is a table of distinct pairs and of what each needs, so a pair is visited once however many ways lead
to it. Then the levels are evaluated from the deepest up. A pair gets the list of those of its needs that failed, so every branch
(``anyOf``, ``not``, ``if``, ``contains`` ...) is decided, and hands its own violations, with those below that belong to it, to the level above.

Levels are written to the shared folder, as there are as many rounds as values are deep; a round moves the pairs of one level and the violations
found below, nothing else. Pairs of one document are spread by (document, place, pointer), so a very large document is no task of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.functions.values import VariantNode, value_at
from conform.plans.rules import NEED, PENDING, VIOLATION, Compiler
from conform.plans.stored import stored, worked_out

#: A schema by the name of its place: (schema, base, root, compiler).
Roots = Mapping[str, tuple[Any, str, Any, Compiler]]
_PAIR = ("__doc", "__place", "__ptr")


def _chosen(names: Sequence[str], made: Mapping[str, Column], empty: str) -> Column:
    none, place = F.array().cast(empty), F.col("__place")
    out = F.when(F.lit(False), none)
    for name in names:
        out = out.when(place == name, made[name])
    return F.coalesce(out, none)


class _Places:
    """The places of a run, compiled when pairs of them turn up."""

    def __init__(self, roots: Roots) -> None:
        self.known: dict[str, tuple[Any, str, Any, Compiler, int]] = {}
        self._needs: dict[str, Column | None] = {}
        self._found: dict[str, Column] = {}
        self._value = VariantNode(F.col("__value"))  # one for all places, so that they share its columns
        self._bad = F.col("__bad")
        for name, (schema, base, root, compiler) in roots.items():
            self.known[name] = (schema, base, root, compiler, 1 << 20)

    def needs(self, name: str) -> Column | None:
        if name not in self._needs:
            schema, base, root, compiler, _ = self.known[name]
            self._needs[name] = compiler.needs(schema, self._value, base, root)
            for inner, (s, b, r, rank) in compiler.places.items():
                self.known.setdefault(inner, (s, b, r, compiler, rank))
        return self._needs[name]

    def found(self, name: str) -> Column:
        if name not in self._found:
            schema, base, root, compiler, _ = self.known[name]
            self._found[name] = compiler.compile(schema, self._value, base, root, self._bad)
        return self._found[name]

    def all_needs(self, names: Sequence[str]) -> Column:
        made = {n: c for n in names if (c := self.needs(n)) is not None}
        return _chosen(list(made), made, f"array<{NEED}>")

    def all_found(self, names: Sequence[str]) -> Column:
        return _chosen(names, {n: self.found(n) for n in names}, f"array<{VIOLATION}>")

    def rank(self) -> Column:
        """A pair's rank among those of its value; a place that is not known yet cannot be needed."""
        return F.coalesce(F.create_map(*[x for n, k in self.known.items() for x in (F.lit(n), F.lit(k[4]))])[F.col("__place")], F.lit(0))


def exploded(rows: DataFrame, keep: Sequence[Column | str], found: Column) -> DataFrame:
    """A row for each violation. An array with a column of its own would be asked for its size first, below the scan's other columns, and so be worked out again with all that it is made of."""
    return rows.select(*keep, F.explode(found).alias("__v")).select("*", "__v.*").drop("__v")


def violations(rows: DataFrame, roots: Roots, keep: Sequence[str], value: str, place: Column) -> DataFrame:
    """``keep..., instance_path, schema_path, kind, message, params`` of rows that each have a VARIANT ``value`` and name a place of ``roots``."""
    places = _Places(roots)
    none = F.array().cast("array<string>")
    renamed = rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(value).alias("__value"), place.alias("__place"), none.alias("__bad"))
    back = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    kept = [f"__k{i}" for i in range(len(keep))]
    names = list(roots)
    needed = places.all_needs(names)
    stops = any(places.needs(n) is not None for n in names)
    if not stops or rows.isStreaming:
        return exploded(renamed, back, places.all_found(names))
    judged = worked_out(renamed, __needs=needed)
    deep = judged.filter(F.size("__needs") > 0).drop("__bad")
    deep = stored(deep.withColumns({"__doc": F.monotonically_increasing_id(), "__ptr": F.lit("")}), "deep-values")
    if deep.isEmpty():
        return exploded(renamed, back, places.all_found(names))
    shallow = exploded(judged.filter(F.size("__needs") == 0), back, places.all_found(names))
    levels = [((0, 0), deep.select(*_PAIR, "__value", "__needs"), names)]
    leads: dict[tuple[int, int], set[tuple[int, int]]] = {}  # the levels that a level's needs lie in
    waiting: list[tuple[DataFrame, dict[tuple[int, int], set[str]]]] = []
    while True:
        each, found = _waiting(levels[-1][1], places)
        leads[levels[-1][0]] = set(found)
        waiting = [w for w in ((each, found), *waiting) if w[1]]
        if not waiting:
            break
        depth, rank = now = min(level for _, left in waiting for level in left)
        pairs, at = None, set()
        for table, left in waiting:
            if now in left:
                at |= left.pop(now)
                part = table.filter((F.col("__depth") == depth) & (F.col("__rank") == rank)).select(*_PAIR, "__value")
                pairs = part if pairs is None else pairs.unionByName(part)
        pairs = pairs.groupBy(*_PAIR).agg(F.first("__value").alias("__value"))
        levels.append((now, stored(pairs.withColumn("__needs", places.all_needs(sorted(at))), "pairs"), sorted(at)))
    done: dict[tuple[int, int], list[DataFrame]] = {}
    for now, pairs, at in reversed(levels):
        done[now] = _evaluated(pairs, at, places, [t for level in leads[now] for t in done[level]])
    if not done[0, 0]:
        return shallow
    top = reduce(DataFrame.unionByName, done[0, 0]).join(deep.select("__doc", "__place", *kept), ["__doc", "__place"])
    out = top.select(*back, "instance_path", "schema_path", "kind", "message", "params")
    return shallow.unionByName(out)


def _waiting(pairs: DataFrame, places: _Places) -> tuple[DataFrame, dict[tuple[int, int], set[str]]]:
    """The pairs that a level needs, with their values, and where they are to be visited: places by (depth, rank)."""
    each = pairs.select("__doc", "__ptr", "__value", F.explode("__needs").alias("__n"))
    each = each.select("__doc", F.col("__n.place").alias("__place"), F.concat("__ptr", "__n.path").alias("__ptr"), "__value", F.col("__n.path").alias("__path"))
    each = each.withColumns({"__depth": F.size(F.split("__ptr", "/")), "__rank": -places.rank()})
    found: dict[tuple[int, int], set[str]] = {}
    for r in each.select("__depth", "__rank", "__place").distinct().collect():  # places of one schema and depths of a level's needs
        found.setdefault((r[0], r[1]), set()).add(r[2])
    return each.withColumn("__value", value_at(F.col("__value"), F.col("__path"))).drop("__path"), found


def _evaluated(pairs: DataFrame, at: Sequence[str], places: _Places, below: Sequence[DataFrame]) -> list[DataFrame]:
    """The violations of one more level, ``__doc, __place, __ptr, instance_path, ...``: its own, and those of the levels below that belong to it."""
    up = [F.col(c).alias(f"{c}_up") for c in _PAIR]
    rows = pairs.withColumn("__bad", F.array().cast("array<string>"))
    if below:
        under = reduce(DataFrame.unionByName, below)
        needs = pairs.select(*_PAIR, F.explode("__needs").alias("__n")).select(*up, "__doc", F.col("__n.place").alias("__place"), F.concat("__ptr", "__n.path").alias("__ptr"), F.concat_ws(" ", "__n.place", "__n.path").alias("__key"))
        failed = needs.join(under.select(*_PAIR).distinct(), list(_PAIR), "left_semi").groupBy(*[f"{c}_up" for c in _PAIR]).agg(F.collect_set("__key").alias("__bad"))
        rows = pairs.join(failed.withColumnsRenamed({f"{c}_up": c for c in _PAIR}), list(_PAIR), "left").withColumn("__bad", F.coalesce("__bad", F.array().cast("array<string>")))
    each = exploded(rows, _PAIR, places.all_found(at))
    each = stored(each.withColumn("instance_path", F.concat("__ptr", "instance_path")), "level-violations")
    kinds = {r[0] for r in each.select(F.col("kind") == PENDING).distinct().collect()}
    out = [each.filter(F.col("kind") != PENDING)] if False in kinds else []
    if True in kinds:
        down = each.filter(F.col("kind") == PENDING).select(*up, "__doc", F.col("message").alias("__place"), F.col("instance_path").alias("__ptr"), F.col("schema_path").alias("__at"))
        lifted = down.join(under, list(_PAIR)).select(*[F.col(f"{c}_up").alias(c) for c in _PAIR], "instance_path", F.concat("__at", "schema_path").alias("schema_path"), "kind", "message", "params")
        out.append(stored(lifted, "violations"))
    return out
