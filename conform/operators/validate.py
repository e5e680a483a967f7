"""Documents against schemas: violations as rows.

Schemas are few and compiled once into expressions; documents are scanned once. Documents of one schema need no
join at all; a corpus with several is split by a condition on the schema's URI inside the same projection, in
groups of ``TOGETHER`` schemas so that no projection becomes larger than the compiler likes.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conform.functions.values import TypedNode
from conform.operators.fixpoint import exploded, violations
from conform.operators.schemagraph import ref_edges, ref_reach, schema_nodes
from conform.plans.rules import VIOLATION, Compiler, UnresolvedReference, effective
from conform.plans.stored import shared_path

TOGETHER = 20


def violation_array(schema: Any, node: Any, store: Mapping[str, Any] | None = None, base: str = "", formats: bool = True) -> Column:
    """All violations of one value as an array, as far as one expression reaches; :func:`validate_one` goes on where it stops."""
    return Compiler(store or {}, formats).compile(schema, node, base)


def row_node(df: DataFrame, columns: Sequence[str] | None = None) -> TypedNode:
    """The rows of a table as JSON objects, without writing them as JSON: types are known when the query is built."""
    names = list(columns or df.columns)
    return TypedNode(F.struct(*names), T.StructType([df.schema[c] for c in names]))


def validate_table(df: DataFrame, schema: Any, keep: Sequence[str], columns: Sequence[str] | None = None, formats: bool = True) -> DataFrame:
    """Violations of a table's rows, typed columns used as they are: ``keep..., instance_path, schema_path, kind, message, params``.

    Where all rules are plain conditions on columns, rows that none of them finds fault with are left out before any violation is built. Types end, so recursive schemas do too.
    """
    compiler = Compiler(formats=formats)
    found = compiler.compile(schema, row_node(df, columns))
    if compiler.plain is not None:
        faulty = F.lit(False)
        for condition in compiler.plain:
            faulty = faulty | F.coalesce(condition, F.lit(False))
        df = df.filter(faulty)
    return exploded(df, keep, found)


def validate_one(docs: DataFrame, schema: Any, keep: Sequence[str] = ("doc_id",), instance: str = "instance", store: Mapping[str, Any] | None = None, base: str = "", formats: bool = True) -> DataFrame:
    """Violations of VARIANT documents under one schema, however deep recursive references lead (see :mod:`conform.operators.fixpoint`).

    A stream has no further rounds here; :func:`conform.streaming.checks.validate_stream` has them in every batch.
    """
    return violations(docs, {"": (schema, base, schema, Compiler(store or {}, formats))}, keep, instance, F.lit(""))


def validate(docs: DataFrame, schemas: Mapping[str, Any], keep: Sequence[str] = ("doc_id", "path"), uri: str = "schema_uri", instance: str = "instance", formats: Mapping[str, bool] | None = None) -> DataFrame:
    """Violations of documents under the schemas that their ``schema_uri`` names; those whose schema is not in the store have none here (see :func:`schema_findings`).

    More schemas than one projection takes are dealt into groups: documents are scanned once, written by group, and every group reads its own part only.
    """
    kept = list(dict.fromkeys([*keep, uri]))
    uris = [u for u in schemas if compile_error(schemas, u) is None]
    groups = [uris[i : i + TOGETHER] for i in range(0, len(uris), TOGETHER)]
    roots = lambda group: {u: (schemas[u], u, schemas[u], Compiler(schemas, (formats or {}).get(u, True))) for u in group}
    if not groups:
        return exploded(docs, kept, F.array().cast(f"array<{VIOLATION}>"))
    if len(groups) == 1 or docs.isStreaming:
        parts = [violations(docs.filter(F.col(uri).isin(*g)), roots(g), kept, instance, F.col(uri)) for g in groups]
        return reduce(DataFrame.unionByName, parts)
    number = docs.sparkSession.createDataFrame([(u, i) for i, g in enumerate(groups) for u in g], "__uri string, __group int")
    dealt = docs.select(*kept, F.col(instance).alias("__instance")).join(F.broadcast(number), F.col(uri) == F.col("__uri")).drop("__uri")  # one row for each schema
    path = shared_path(docs.sparkSession, "documents-by-schema")
    dealt.write.partitionBy("__group").parquet(path)
    written = docs.sparkSession.read.schema(dealt.schema).parquet(path)
    return reduce(DataFrame.unionByName, [violations(written.filter(F.col("__group") == i), roots(g), kept, "__instance", F.col(uri)) for i, g in enumerate(groups)])


def schemas_of(docs: DataFrame, store: DataFrame, uri: str = "schema_uri", most: int = 10_000) -> dict[str, Any]:
    """The schemas that documents name, and all that they refer to, from a store table ``uri, body``, parsed for :func:`validate`.

    Only schemas that some document reaches come to the driver; more than ``most`` are an error, since each becomes part of a plan.
    """
    import json

    edges = ref_edges(schema_nodes(store)).filter("base <> ''").select("src_uri", "base")
    named = docs.filter(F.col(uri).isNotNull()).select(F.col(uri).alias("uri")).distinct()
    reached = ref_reach(edges, named).select("uri")
    rows = store.join(reached, "uri", "left_semi").select("uri", "body").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"documents name more than {most} schemas")
    return {r.uri: json.loads(r.body) for r in rows}


#: What a reference may look like.
_REFERENCE = re.compile(r"(?:[!#$&-;=?-Z\[\]_a-z~\u00a0-\U0010fffd]|%[0-9A-Fa-f]{2})*")


def compile_error(schemas: Mapping[str, Any], uri: str) -> str | None:
    """Why a schema cannot be compiled, or None. Nothing runs for it: references are followed in the schemas alone."""
    seen: set[tuple[str, str]] = set()

    def walk(value: Any, base: str, root: Any) -> str | None:
        if isinstance(value, dict):
            value = effective(value, root)
            ref = value.get("$ref")
            if isinstance(ref, str) and (base, ref) not in seen:
                seen.add((base, ref))
                if not _REFERENCE.fullmatch(ref):
                    return f'"{ref}" is not a "uri-reference"'
                try:
                    target, new_base, new_root = compiler._resolve(ref, base, root)
                except UnresolvedReference:
                    return f"unresolved reference {ref}"
                if (found := walk(target, new_base, new_root)) is not None:
                    return found
            return next((x for x in (walk(v, base, root) for k, v in value.items() if k not in ("enum", "const", "default", "examples")) if x is not None), None)
        if isinstance(value, list):
            return next((x for x in (walk(v, base, root) for v in value) if x is not None), None)
        return None

    compiler = Compiler(schemas)
    return walk(schemas[uri], uri, schemas[uri])


def schema_findings(docs: DataFrame, schemas: Mapping[str, Any], uri: str = "schema_uri", formats: Mapping[str, bool] | None = None) -> DataFrame:
    """A diagnostic for every document whose schema is missing (``schema_fetch``) or does not compile (``schema_compile``).

    A reference that is no URI reference is passed over where ``formats`` turns the schema's formats off.
    """
    known = list(schemas)
    broken = {u: e for u in known if (e := compile_error(schemas, u)) is not None and not ("uri-reference" in e and not (formats or {}).get(u, True))}
    missing = docs.filter(F.col(uri).isNotNull() & ~F.col(uri).isin(*known)) if known else docs.filter(F.col(uri).isNotNull())
    out = missing.select("path", F.lit("schema_fetch").alias("code"), F.concat(F.lit("no schema at "), F.col(uri)).alias("message"))
    if broken:
        said = F.when(F.lit(False), F.lit(""))
        for u, e in broken.items():
            said = said.when(F.col(uri) == u, F.lit(e))
        out = out.unionByName(docs.filter(F.col(uri).isin(*broken)).select("path", F.lit("schema_compile").alias("code"), said.alias("message")))
    return out


def violations_under(violations: DataFrame, pointer: str) -> DataFrame:
    """Violations at a JSON pointer or below it."""
    return violations if not pointer else violations.filter((F.col("instance_path") == pointer) | F.col("instance_path").startswith(pointer + "/"))
