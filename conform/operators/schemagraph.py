"""Schemas as tables of nodes: references between them, integrity, rewriting to the newest draft, and trees built again.

A node is a JSON value of a schema: ``uri, id`` (its pointer)``, parent, key, pos, depth, jtype, text`` (of a scalar)``, role, prole, pkey,
gpkey``. The role says whether the value stands where a schema stands (``schema``), in a map or list of schemas (``map``, ``list``), or elsewhere
(``plain``). Rules change rows: a rename changes a key, a move changes a parent, so no pointer has to follow.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.functions.numbers import let
from conform.functions.urls import base_of, fragment_of, url_join
from conform.functions.values import value_at
from conform.plans.stored import meet, ship, spread, stored, worked_out
from conform.sources.documents import parse_jsonc

NEWEST = "https://json-schema.org/draft/2020-12/schema"
#: Keywords whose value is a schema, a map of schemas, a list of schemas.
SINGLE = ("additionalItems", "additionalProperties", "contains", "contentSchema", "else", "if", "items", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties")
MAPS = ("$defs", "definitions", "dependentSchemas", "patternProperties", "properties")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
#: Keywords by which an object without a type is taken for a schema of objects.
INDICATORS = ("$ref", "$id", "$schema", "$defs", "definitions", "allOf", "oneOf", "anyOf", "not", "if", "then", "else", "required", "additionalProperties", "patternProperties", "items", "prefixItems", "enum", "const", "dependentSchemas", "dependentRequired", "dependencies")
LIKE_SCHEMA = (*INDICATORS, "type", "properties")
#: Keywords that make an object a schema and no namespace of definitions.
SCHEMA_KEYWORDS = ("type", "properties", "$ref", "allOf", "oneOf", "anyOf", "items", "required", "enum", "not", "if", "then", "else", "patternProperties", "additionalProperties")
#: Keywords whose value is a boolean that holds if either of two schemas says so.
FLAGS = ("deprecated", "readOnly", "writeOnly", "uniqueItems")
#: Keywords that a branch of ``allOf`` does not hand on.
OWN = ("allOf", "anyOf", "oneOf", "$schema", "$id", "title", "description", "markdownDescription")


def detect_draft(schema_uri: Column) -> Column:
    """The draft that a ``$schema`` value names; null for another."""
    out = F.when(F.lit(False), F.lit(""))
    for part, name in (("draft-04", "draft-04"), ("draft-06", "draft-06"), ("draft-07", "draft-07"), ("2019-09", "2019-09"), ("2020-12", "2020-12")):
        out = out.when(schema_uri.contains(part), F.lit(name))
    return out


def schema_nodes(store: DataFrame, deepest: int | None = None) -> DataFrame:
    """The nodes of every schema of ``uri, body``, level by level, as the role of a value follows from its parent's.

    Schemas are a small part of the data; each level's table is written once, and there are as many as the deepest schema has. With ``deepest``,
    what lies deeper stays text.
    """
    held = lambda t: F.try_variant_get("v", "$", t).isNotNull()
    # one level is looked at; the kind's text would name all below
    kind = F.when(held("map<string,variant>"), "OBJECT").when(held("array<variant>"), "ARRAY").otherwise(F.regexp_extract(F.schema_of_variant("v"), r"^([A-Z]+)", 1))
    step = F.concat(F.lit("/"), F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    key, prole = F.col("key"), F.col("prole")
    in_schema = F.when(key.isin(*MAPS), "map").when((key == "items") & (F.col("jtype") == "ARRAY"), "list").when(key.isin(*LISTS), "list").when(key.isin(*SINGLE), "schema").when(key == "dependencies", "deps").otherwise("plain")
    role = F.when(prole == "schema", in_schema).when(prole.isin("map", "list"), "schema").when((prole == "deps") & (F.col("jtype") != "ARRAY"), "schema").otherwise("plain")
    none = F.lit(None).cast("string")
    rows = worked_out(spread(store.select("uri", "body")), v=parse_jsonc(F.col("body"))).select("uri", "v").filter("v IS NOT NULL")
    level = stored(rows.select("uri", F.lit("").alias("id"), none.alias("parent"), none.alias("key"), F.lit(0).cast("long").alias("pos"), kind.alias("jtype"), F.lit("schema").alias("role"), none.alias("prole"), none.alias("pkey"), none.alias("gpkey"), "v"), "schema-level")
    out, depth = None, 0
    while True:
        last = deepest is not None and depth >= deepest
        text = F.to_json("v") if last else F.when(~F.col("jtype").isin("OBJECT", "ARRAY"), F.to_json("v"))
        part = level.select("uri", "id", "parent", "key", "pos", F.lit(depth).alias("depth"), "jtype", text.alias("text"), "role", "prole", "pkey", "gpkey")
        out = part if out is None else out.unionByName(part)
        inner = level.filter(F.col("jtype").isin("OBJECT", "ARRAY"))
        if last or inner.isEmpty():
            return stored(out, "schema-nodes")
        entries = F.when(F.col("jtype") == "OBJECT", F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e, i: F.struct(e["key"].alias("key"), i.alias("pos"), e["value"].alias("v"))))
        items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), i.alias("pos"), x.alias("v")))
        below = inner.select("uri", F.col("id").alias("parent"), F.col("role").alias("prole"), F.col("key").alias("pkey"), F.col("pkey").alias("gpkey"), F.explode(F.coalesce(entries, items)).alias("c"))
        below = below.select("uri", "parent", "prole", "pkey", "gpkey", "c.key", F.col("c.pos").cast("long").alias("pos"), "c.v").withColumn("jtype", kind)
        level = stored(below.select("uri", F.concat("parent", step).alias("id"), "parent", "key", "pos", "jtype", role.alias("role"), "prole", "pkey", "gpkey", "v"), "schema-level")
        depth += 1


def _unquoted(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "string")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.to_variant_object(F.array(text))), r"^\[(.*)\]$", "$1")


# -- references -------------------------------------------------------------


def ref_edges(nodes: DataFrame) -> DataFrame:
    """``src_uri, src_path, ref_key, ref, base, fragment`` of every ``$ref``."""
    ref = _unquoted(F.col("text"))
    rows = nodes.filter((F.col("key") == "$ref") & (F.col("jtype") == "STRING") & (F.col("prole") == "schema")).withColumn("ref", ref)
    return rows.select(F.col("uri").alias("src_uri"), F.col("parent").alias("src_path"), F.col("key").alias("ref_key"), "ref", base_of(F.col("ref")).alias("base"), fragment_of(F.col("ref")).alias("fragment"))


def external_refs(edges: DataFrame) -> DataFrame:
    """The distinct remote targets of every schema."""
    return edges.filter(F.col("base").rlike("^https?://")).select("src_uri", "base").distinct()


def relative_refs(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("base") != "") & ~F.col("base").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).select("src_uri", "src_path", "ref", "base")


def resolve_relative_refs(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """Relative references made absolute by their schema's canonical URL (``uri, canonical``)."""
    rows = edges.join(bases.withColumnRenamed("uri", "src_uri"), "src_uri", "left")
    remote = F.col("ref").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return rows.withColumn("resolved", F.when(remote, F.col("ref")).when(F.col("ref").startswith("#"), F.concat(F.coalesce("canonical", "src_uri"), "ref")).otherwise(url_join(F.coalesce("canonical", "src_uri"), F.col("ref"))))


def sibling_refs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Relative references to members of the same group: ``members`` has ``group, key, canonical``; ``edges`` also ``group``. ``./k.json`` and ``k.json`` are alike."""
    key = F.regexp_replace(F.regexp_replace("base", r"^\./", ""), r"\.json$", "")
    return edges.withColumn("key", key).join(members, ["group", "key"], "left")


def rewrite_refs(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Replace references' bases by ``targets`` (``base, target``), fragments kept."""
    ref = _unquoted(F.col("text"))
    is_ref = (F.col("key") == "$ref") & (F.col("jtype") == "STRING")
    rows = nodes.withColumn("__base", F.when(is_ref, base_of(ref)))
    rows = rows.join(targets.select(F.col("base").alias("__base"), "target"), "__base", "left")
    new = F.concat("target", F.when(ref.contains("#"), F.concat(F.lit("#"), fragment_of(ref))).otherwise(F.lit("")))
    return rows.withColumn("text", F.when(F.col("target").isNotNull(), F.concat(F.lit('"'), new, F.lit('"'))).otherwise(F.col("text"))).select(*nodes.columns)


def absolute_refs(nodes: DataFrame) -> DataFrame:
    """Local references made absolute by the root's ``$id``."""
    roots = nodes.filter((F.col("parent") == "") & (F.col("key") == "$id")).select("uri", _unquoted(F.col("text")).alias("__id"))
    rows = nodes.join(roots, "uri", "left")
    local = (F.col("key") == "$ref") & F.col("text").startswith('"#') & F.col("__id").isNotNull()
    return rows.withColumn("text", F.when(local, F.concat(F.lit('"'), base_of(F.col("__id")), F.substring("text", F.lit(2), F.length("text")))).otherwise(F.col("text"))).select(*nodes.columns)


def ref_closure(edges: DataFrame, src: str = "src_uri", dst: str = "base", rounds: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """``root, uri, hops``: all that every schema reaches, or that those of ``roots`` (``uri``) do, within ``rounds`` steps.

    The frontier is joined with the edges and what was visited is taken out, so cycles end; each round writes its frontier alone, since executors may go.
    """
    steps = stored(edges.select(F.col(src).alias("__src"), F.col(dst).alias("__dst")).distinct(), "ref-edges")
    first = steps if roots is None else meet(steps, roots.select(F.col("uri").alias("__src")).distinct(), ["__src"], "left_semi")
    seen = frontier = first.select(F.col("__src").alias("root"), F.col("__dst").alias("uri"), F.lit(1).alias("hops"))
    hops = 1
    while rounds is None or hops < rounds:
        hops += 1
        near = meet(frontier.withColumnRenamed("uri", "__src"), steps, ["__src"]).select("root", F.col("__dst").alias("uri")).distinct()
        frontier = stored(meet(near, seen, ["root", "uri"], "left_anti").withColumn("hops", F.lit(hops)), "ref-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ref_reach(edges: DataFrame, roots: DataFrame, src: str = "src_uri", dst: str = "base", rounds: int | None = None) -> DataFrame:
    """``uri``: all that the given roots (``uri``) reach together, themselves included. Each node is visited once, so a chain of n costs n rows, not n²; each round writes its frontier alone."""
    steps = stored(edges.select(F.col(src).alias("__src"), F.col(dst).alias("uri")).distinct(), "ref-edges")
    seen = frontier = stored(roots.select("uri").distinct(), "ref-roots")
    hops = 0
    while rounds is None or hops < rounds:
        hops += 1
        near = meet(frontier.withColumnRenamed("uri", "__src"), steps, ["__src"]).select("uri").distinct()
        frontier = stored(meet(near, seen, ["uri"], "left_anti"), "ref-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def refs_to_fetch(edges: DataFrame, known: DataFrame) -> DataFrame:
    """External targets that the store does not have yet."""
    return external_refs(edges).select(F.col("base").alias("uri")).distinct().join(known.select("uri"), "uri", "left_anti")


def dangling_refs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose schema or place in it does not exist: ``src_uri, src_path, ref``."""
    target = F.when(F.col("base") == "", F.col("src_uri")).otherwise(F.col("base"))
    rows = edges.withColumns({"uri": target, "id": F.coalesce(F.url_decode("fragment"), F.lit(""))})
    pointers = rows.filter((F.col("id") == "") | F.col("id").startswith("/"))
    anchors = rows.filter(~((F.col("id") == "") | F.col("id").startswith("/")))
    named = nodes.filter(F.col("key").isin("$anchor", "$dynamicAnchor")).select("uri", _unquoted(F.col("text")).alias("id"))
    lost = pointers.join(nodes.select("uri", "id"), ["uri", "id"], "left_anti").unionByName(anchors.join(named, ["uri", "id"], "left_anti"))
    return lost.select("src_uri", "src_path", "ref")


def shape_errors(nodes: DataFrame) -> DataFrame:
    """Values of the wrong kind at a schema's keywords: ``uri, path, message``."""
    wrong = lambda keys, kinds, said: ((F.col("prole") == "schema") & F.col("key").isin(*keys) & ~F.col("jtype").isin(*kinds), said)
    rules = [
        (F.col("role").isin("schema") & ~F.col("jtype").isin("OBJECT", "BOOLEAN"), "expected a schema"),
        wrong(MAPS, ("OBJECT",), "expected an object of schemas"),
        wrong(LISTS, ("ARRAY",), "expected an array of schemas"),
        wrong(("required", "enum", "examples"), ("ARRAY",), "expected an array"),
        wrong(("type",), ("STRING", "ARRAY"), "expected a type name or an array of them"),
    ]
    said = F.coalesce(*[F.when(c, m) for c, m in rules])
    return nodes.withColumn("message", said).filter("message IS NOT NULL").select("uri", F.col("id").alias("path"), "message")


def schema_errors(nodes: DataFrame) -> DataFrame:
    """Dangling references and wrong shapes of every schema; a schema without a row compiles."""
    lost = dangling_refs(ref_edges(nodes), nodes).select(F.col("src_uri").alias("uri"), F.col("src_path").alias("path"), F.concat(F.lit("unresolved reference "), "ref", F.when(F.col("ref").startswith("#"), F.lit("")).otherwise(F.lit(": it does not exist"))).alias("message"))
    return lost.unionByName(shape_errors(nodes))


def lookup_pointer(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Follow local references from ``uri, id`` to the node that holds the value, however many there are: ``uri, id, found``; cycles end without a row."""
    refs = nodes.filter((F.col("key") == "$ref") & F.col("text").startswith('"#')).select("uri", F.col("parent").alias("at"), F.url_decode(F.substring(_unquoted(F.col("text")), F.lit(2), F.length("text"))).alias("to"))
    open_ = wanted.select("uri", "id", F.col("id").alias("at"), F.array("id").alias("passed"))
    done = None
    while True:
        stepped = stored(meet(open_, refs, ["uri", "at"], "left"), "pointer-steps")
        part = stepped.filter("to IS NULL").select("uri", "id", "at")
        done = part if done is None else done.unionByName(part)
        onward = stepped.filter(F.col("to").isNotNull() & ~F.array_contains("passed", F.col("to")))
        open_ = onward.select("uri", "id", F.col("to").alias("at"), F.concat("passed", F.array("to")).alias("passed"))
        if open_.isEmpty():
            break
    return meet(done, nodes.select("uri", F.col("id").alias("at")), ["uri", "at"]).select("uri", "id", F.col("at").alias("found"))


def property_names_at(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The properties that a schema declares at ``uri, id``, through references and ``allOf``: ``uri, id, name``. The frontier of places is written each round; a place is visited once."""
    props = nodes.filter((F.col("prole") == "map") & (F.col("pkey") == "properties")).select("uri", F.regexp_replace("parent", "/properties$", "").alias("at"), F.col("key").alias("name"))
    branches = nodes.filter((F.col("prole") == "list") & (F.col("pkey") == "allOf")).select("uri", F.regexp_replace("parent", "/allOf$", "").alias("at"), F.col("id").alias("to"))
    seen = None
    front = stored(wanted.select("uri", "id", F.col("id").alias("at")).distinct(), "property-places")
    while not front.isEmpty():
        found = lookup_pointer(nodes, front.select("uri", F.col("at").alias("id")).distinct()).withColumnRenamed("id", "at")
        found = front.join(found, ["uri", "at"]).select("uri", "id", F.col("found").alias("at")).distinct()
        found = stored(found if seen is None else found.join(seen, ["uri", "id", "at"], "left_anti"), "property-owners")
        seen = found if seen is None else seen.unionByName(found)
        front = stored(found.join(branches, ["uri", "at"]).select("uri", "id", F.col("to").alias("at")).distinct(), "property-places")
    return nodes.select("uri").limit(0).selectExpr("uri", "uri AS id", "uri AS name") if seen is None else seen.join(props, ["uri", "at"]).select("uri", "id", "name").distinct()


# -- trees ------------------------------------------------------------------


def rebuild(nodes: DataFrame) -> DataFrame:
    """``uri, body``: schemas from their nodes. The nodes of one schema meet in one task, which holds one schema at a time, and are put together from the leaves up.

    Elements of ``enum`` and ``required`` are kept once. Nodes whose parent is gone go with it.
    """
    ship(nodes.sparkSession)
    key = F.col("key")
    name = F.when(key.rlike(r"^[A-Za-z0-9_$./:-]*$"), F.concat(F.lit('"'), key, F.lit('"'))).otherwise(F.regexp_replace(F.to_json(F.to_variant_object(F.struct(key.alias("k")))), r'^\{"k":(.*)\}$', "$1"))
    shape = F.when(F.col("jtype") != "ARRAY", "object").when(key.isin("enum", "required"), "set").otherwise("list")
    rows = nodes.select("uri", "id", "parent", "pos", "key", name.alias("name"), shape.alias("shape"), "text")

    def built(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        uri, roots, below = None, [], {}

        def bodies():  # noqa: ANN202
            for root in roots:
                order, spans = [root], []
                for node in order:  # grows on the way: a node's children stand side by side
                    spans.append((len(order), len(order) + (len(below.get(node[0], ())) if node[5] is None else 0)))
                    order += below.get(node[0], ()) if node[5] is None else ()
                texts = [node[5] for node in order]
                for i in range(len(order) - 1, -1, -1):
                    if texts[i] is None:
                        inner = sorted((order[j][1], order[j][2], texts[j], order[j][3]) for j in range(*spans[i]))
                        if order[i][4] == "object":
                            texts[i] = "{" + ",".join([f"{x[3]}:{x[2]}" for x in inner]) + "}"
                        else:
                            cells = [x[2] for x in inner]
                            texts[i] = "[" + ",".join(dict.fromkeys(cells) if order[i][4] == "set" else cells) + "]"
                yield texts[0]

        def made(uris, found):  # noqa: ANN001, ANN202
            return pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(found, pa.string())], names=["uri", "body"])

        for batch in batches:
            uris, found = [], []
            for u, id_, parent, *node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if u != uri:
                    for body in bodies():
                        uris.append(uri)
                        found.append(body)
                    uri, roots, below = u, [], {}
                (roots if parent is None else below.setdefault(parent, [])).append((id_, *node))
            yield made(uris, found)
        last = list(bodies())
        yield made([uri] * len(last), last)

    return stored(rows.repartition("uri").sortWithinPartitions("uri").mapInArrow(built, "uri string, body string"), "tree")


def patch_root(nodes: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Set a keyword of every root to the JSON texts of ``uri, text``."""
    rest = nodes.filter(~(F.col("parent").eqNullSafe("") & F.col("key").eqNullSafe(F.lit(key))))
    fresh = values.select("uri", F.lit(f"/{key}").alias("id"), F.lit("").alias("parent"), F.lit(key).alias("key"), F.lit(-1).cast("long").alias("pos"), F.lit(1).alias("depth"), F.lit("STRING").alias("jtype"), "text", F.lit("plain").alias("role"), F.lit("schema").alias("prole"), F.lit(None).cast("string").alias("pkey"), F.lit(None).cast("string").alias("gpkey"))
    return rest.unionByName(fresh)


# -- migration --------------------------------------------------------------


def migrate_nodes(nodes: DataFrame) -> DataFrame:
    """All rules of a migration to 2020-12, as changes of rows; facts about siblings come from one window."""
    from conform.functions.regexes import repaired_regex

    ship(nodes.sparkSession)

    @F.pandas_udf("string")
    def repaired(x: pd.Series) -> pd.Series:
        return x.map(repaired_regex)

    w = Window.partitionBy("uri", "parent")
    key, kind, text = F.col("key"), F.col("jtype"), F.col("text")
    has = lambda *ks: F.coalesce(F.max(key.isin(*ks)).over(w), F.lit(False))
    holds = lambda c: F.coalesce(F.max(c).over(w), F.lit(False))
    drafts = nodes.filter((F.col("parent") == "") & (key == "$schema")).select("uri", detect_draft(_unquoted(text)).alias("draft"))
    rows = meet(nodes, drafts, ["uri"], "left").withColumn("old", F.coalesce(F.col("draft") != "2020-12", F.lit(True)))
    rows = rows.withColumns({
        "like": has(*LIKE_SCHEMA), "has_id": has("$id"), "has_defs": has("$defs"), "has_ref": has("$ref"), "list_items": holds((key == "items") & (kind == "ARRAY")),
        "min_true": holds((key == "exclusiveMinimum") & (text == "true")), "max_true": holds((key == "exclusiveMaximum") & (text == "true")),
    })
    inside, old = F.col("prole") == "schema", F.col("old")
    is_text = kind == "STRING"
    hash_text = is_text & text.startswith('"#')
    new_key = (
        F.when(inside & old & (key == "id") & is_text & ~hash_text & ~F.col("has_id") & F.col("like"), "$id")
        .when(inside & old & (key == "definitions"), "$defs")
        .when(inside & old & (key == "items") & (kind == "ARRAY"), "prefixItems")
        .when(inside & old & (key == "additionalItems") & F.col("list_items"), "items")
        .when(inside & old & (key == "minimum") & F.col("min_true"), "exclusiveMinimum")
        .when(inside & old & (key == "maximum") & F.col("max_true"), "exclusiveMaximum")
        .otherwise(key)
    )
    drop = (
        (inside & old & (key == "id") & hash_text)
        | (inside & old & (key == "definitions") & F.col("has_defs"))
        | (inside & old & key.isin("exclusiveMinimum", "exclusiveMaximum") & (kind == "BOOLEAN"))
        | (inside & old & (key == "dependencies"))
        | (inside & (key == "$id") & hash_text)
        | (inside & key.isin("description", "title", "$comment") & (kind == "VOID"))
        | (inside & (key == "required") & (F.col("gpkey") == "properties") & (kind != "ARRAY"))
        | (inside & (key == "type") & ~kind.isin("STRING", "ARRAY"))
        | (inside & (key == "enum") & (kind != "ARRAY"))
        | (inside & (F.col("depth") == 1) & (key == "$schema"))
        | ((F.col("prole") == "map") & ~kind.isin("OBJECT", "BOOLEAN", "ARRAY"))
        | ((F.col("prole") == "map") & F.col("pkey").isin("$defs", "definitions") & (kind == "ARRAY"))
    )
    new_text = (
        F.when(inside & old & key.isin("$id", "id", "$ref") & is_text, F.replace(text, F.lit("/definitions/"), F.lit("/$defs/")))
        .when(inside & (key == "deprecated") & is_text, F.lit("true"))
        .when(inside & key.isin("additionalProperties", "unevaluatedProperties", "unevaluatedItems") & text.isin('"true"', '"false"'), F.replace(text, F.lit('"'), F.lit("")))
        .otherwise(text)
    )
    # patterns are repaired once for each distinct one, then joined back
    pattern_key, pattern_text = (F.col("prole") == "map") & (F.col("pkey") == "patternProperties"), inside & (key == "pattern") & is_text
    rows = rows.withColumns({"drop": F.coalesce(drop, F.lit(False)), "nkey": new_key, "ntext": new_text, "__pat": F.when(pattern_text, _unquoted(text)).when(pattern_key, key)})
    patterns = nodes.filter(F.coalesce(pattern_text, F.lit(False)) | F.coalesce(pattern_key, F.lit(False))).select(F.when(pattern_text, _unquoted(text)).otherwise(key).alias("__pat"))
    fixed = patterns.filter("__pat IS NOT NULL").distinct().withColumn("__fixed", repaired("__pat"))
    rows = meet(rows, fixed, ["__pat"], "left") if not patterns.isEmpty() else rows.withColumn("__fixed", F.lit(None).cast("string"))
    rows = rows.withColumns({"nkey": F.when(pattern_key, F.col("__fixed")).otherwise(F.col("nkey")), "ntext": F.when(pattern_text, _quoted(F.col("__fixed"))).otherwise(F.col("ntext"))})
    marked = stored(rows.drop("__pat", "__fixed"), "migrate-marked")

    def added(df: DataFrame, id_: Column, parent: Column, k: Column, pos: Column, jtype: Column, t: Column) -> DataFrame:
        return df.select("uri", id_.alias("id"), parent.alias("parent"), k.alias("key"), pos.cast("long").alias("pos"), jtype.alias("jtype"), t.cast("string").alias("text"))

    none, last = F.lit(None), F.lit(1_000_000)
    kept = marked.filter("NOT drop")
    # dependencies: lists of names go to one keyword, schemas to another
    dependents = F.when(kept["jtype"] == "ARRAY", F.lit("dependentRequired")).otherwise(F.lit("dependentSchemas"))
    owner = lambda tail: F.regexp_replace("parent", tail, "")
    dep = kept.filter((F.col("prole") == "deps") & F.col("old")).withColumn("__to", F.concat(owner(r"/dependencies$"), F.lit("/"), dependents))
    moved = added(dep, F.col("id"), F.col("__to"), F.col("nkey"), F.col("pos"), F.col("jtype"), F.col("ntext"))
    boxes = dep.select("uri", "__to").distinct()
    boxes = added(boxes, F.col("__to"), F.regexp_replace("__to", r"/dependent\w+$", ""), F.regexp_extract("__to", r"/(dependent\w+)$", 1), last, F.lit("OBJECT"), none)
    rest = kept.filter(~(F.col("prole").eqNullSafe("deps") & F.col("old")))
    # values that have to stand in an array or an object of their own
    bare = (F.col("prole") == "schema") & (F.col("key") == "examples") & (F.col("jtype") != "ARRAY")
    loose = (F.col("role") == "schema") & (F.col("jtype") == "ARRAY") & F.col("parent").isNotNull()
    box = rest.filter(bare | loose)
    wrapping = added(box, F.concat("id", F.lit("#box")), F.col("parent"), F.col("nkey"), F.col("pos"), F.when(bare, "ARRAY").otherwise("OBJECT"), none)
    plain = added(rest, F.col("id"), F.when(bare | loose, F.concat("id", F.lit("#box"))).otherwise(F.col("parent")), F.when(bare, "0").when(loose, "enum").otherwise(F.col("nkey")), F.col("pos"), F.col("jtype"), F.col("ntext"))
    # required: true inside a property belongs to the parent's list
    marks = marked.filter((F.col("prole") == "schema") & (F.col("key") == "required") & (F.col("gpkey") == "properties") & (F.col("text") == "true"))
    marks = marks.withColumn("__to", F.concat(F.regexp_replace("parent", r"/properties/[^/]*$", ""), F.lit("/required")))
    name = F.regexp_replace(F.to_json(F.to_variant_object(F.struct(F.col("pkey").alias("k")))), r'^\{"k":(.*)\}$', "$1")
    wanted = added(marks, F.col("id"), F.col("__to"), F.concat(F.lit("+"), "pkey"), last + F.col("pos"), F.lit("STRING"), name)
    lists = added(marks.select("uri", "__to").distinct(), F.col("__to"), F.regexp_replace("__to", "/required$", ""), F.lit("required"), last, F.lit("ARRAY"), none)
    # an object schema that says so only by its properties
    facts = marked.filter((F.col("prole") == "schema") & ~F.col("drop")).groupBy("uri", "parent").agg(F.max(F.col("nkey") == "type").alias("typed"), F.max((F.col("key") == "properties") & (F.col("jtype") == "OBJECT")).alias("props"), F.max(F.col("key").isin(*INDICATORS)).alias("told"))
    typed = facts.filter("NOT typed AND props AND told")
    types = added(typed, F.concat("parent", F.lit("/type")), F.col("parent"), F.lit("type"), last + 1, F.lit("STRING"), F.lit('"object"'))
    # a reference that stood in place of an enum's list
    refs = marked.filter((F.col("pkey") == "enum") & (F.col("key") == "$ref") & (F.col("jtype") == "STRING")).withColumn("__to", owner("/enum$"))
    free = meet(refs, marked.filter((F.col("prole") == "schema") & (F.col("key") == "$ref")).select("uri", F.col("parent").alias("__to")), ["uri", "__to"], "left_anti")
    lifted = added(free, F.concat("__to", F.lit("/$ref")), F.col("__to"), F.lit("$ref"), last, F.lit("STRING"), F.replace("ntext", F.lit("/definitions/"), F.lit("/$defs/")))
    # annotations written among the definitions belong to the schema above
    notes = marked.filter((F.col("prole") == "map") & F.col("pkey").isin("$defs", "definitions") & F.col("key").isin("description", "title", "$comment") & (F.col("jtype") == "STRING")).withColumn("__to", owner(r"/(\$defs|definitions)$"))
    free = meet(notes, marked.filter("prole = 'schema'").select("uri", F.col("parent").alias("__to"), "key"), ["uri", "__to", "key"], "left_anti")
    promoted = added(free, F.concat("__to", F.lit("/"), "key"), F.col("__to"), F.col("key"), last, F.lit("STRING"), F.col("text"))
    roots = marked.filter("parent IS NULL AND jtype = 'OBJECT'")
    newest = added(roots, F.lit("/$schema"), F.lit(""), F.lit("$schema"), F.lit(-2), F.lit("STRING"), F.lit(f'"{NEWEST}"'))
    out = plain
    for part in (moved, wrapping, wanted, types, lifted, promoted, newest):
        out = out.unionByName(part)
    held = out.select("uri", F.col("id"))
    for part in (boxes, lists):
        out = out.unionByName(meet(part, held, ["uri", "id"], "left_anti"))
    return stored(out, "migrated")


def namespaces(nodes: DataFrame) -> DataFrame:
    """Definitions that are no schemas but hold some: ``uri, id, parent, key``. An object of at least two members, all objects or booleans, none of them a schema's keyword."""
    inside = nodes.filter(F.col("parent").isNotNull()).groupBy("uri", F.col("parent").alias("id"))
    facts = inside.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("jtype").isin("OBJECT", "BOOLEAN")).alias("plain"), F.bool_or(F.col("key").isin(*SCHEMA_KEYWORDS)).alias("told"))
    boxes = nodes.filter((F.col("prole") == "map") & F.col("pkey").isin("$defs", "definitions") & (F.col("jtype") == "OBJECT")).select("uri", "id", "parent", "key")
    return meet(boxes, facts.filter("n >= 2 AND plain AND NOT told").select("uri", "id"), ["uri", "id"])


def without_namespaces(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Nodes with the members of ``boxes`` (see :func:`namespaces`) moved up among the definitions, where a name that is taken stays as it was, and references to them rewritten."""
    up = boxes.select("uri", F.col("id").alias("parent"), F.col("parent").alias("__up"), F.col("key").alias("__box"))
    moved = nodes.join(F.broadcast(up), ["uri", "parent"], "left") if up.count() <= 100_000 else meet(nodes, up, ["uri", "parent"], "left")
    taken = meet(nodes, boxes.select("uri", "id"), ["uri", "id"], "left_anti").select("uri", F.col("parent").alias("__up"), "key")
    members = meet(moved.filter("__up IS NOT NULL"), taken, ["uri", "__up", "key"], "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("uri", "__up", "key").orderBy("__box"))).filter("__n = 1")
    rest = meet(moved.filter("__up IS NULL"), boxes.select("uri", "id"), ["uri", "id"], "left_anti")
    cells = ["uri", "id", "key", "pos", "jtype", "text"]
    out = rest.select(*cells, "parent").unionByName(members.select(*cells, F.col("__up").alias("parent")))
    # '#/$defs/box/name...' means '#/$defs/name...' now
    where = r'^("[^#"]*#/(?:\$defs|definitions))/([^/"]+)(/[^"]*")$'
    is_ref = (F.col("key") == "$ref") & (F.col("jtype") == "STRING")
    out = meet(out.withColumn("__k", F.when(is_ref, F.regexp_extract("text", where, 2))), boxes.select("uri", F.col("key").alias("__k"), F.lit(True).alias("__hit")).distinct(), ["uri", "__k"], "left")
    return out.withColumn("text", F.when(F.col("__hit"), F.regexp_replace("text", where, "$1$3")).otherwise(F.col("text"))).drop("__k", "__hit")


def flat_definitions(nodes: DataFrame) -> DataFrame:
    """Nodes of the same schemas without namespaces among their definitions; only schemas that have one are built anew, a round for each level of them."""
    while True:
        boxes = stored(namespaces(nodes), "namespaces")
        if boxes.isEmpty():
            return nodes
        mine = meet(nodes, boxes.select("uri").distinct(), ["uri"], "left_semi")
        nodes = meet(nodes, boxes.select("uri").distinct(), ["uri"], "left_anti").unionByName(schema_nodes(rebuild(without_namespaces(mine, boxes))))


def migrate_schemas(store: DataFrame) -> DataFrame:
    """``uri, body`` of every schema as a 2020-12 schema; doing it twice changes nothing more."""
    return rebuild(migrate_nodes(flat_definitions(schema_nodes(store))))


def rule_hits(nodes: DataFrame) -> DataFrame:
    """How often each kind of change would be made, by schema and draft."""
    inside = F.col("prole") == "schema"
    rules = {
        "id": inside & (F.col("key") == "id"), "definitions": inside & (F.col("key") == "definitions"), "items_array": inside & (F.col("key") == "items") & (F.col("jtype") == "ARRAY"),
        "boolean_bound": inside & F.col("key").isin("exclusiveMinimum", "exclusiveMaximum") & (F.col("jtype") == "BOOLEAN"), "dependencies": inside & (F.col("key") == "dependencies"),
        "deprecated_text": inside & (F.col("key") == "deprecated") & (F.col("jtype") == "STRING"), "required_mark": inside & (F.col("key") == "required") & (F.col("jtype") == "BOOLEAN"), "bare_examples": inside & (F.col("key") == "examples") & (F.col("jtype") != "ARRAY"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return nodes.select("uri", F.explode(hits).alias("rule")).groupBy("uri", "rule").agg(F.count(F.lit(1)).alias("n"))


# -- merging ----------------------------------------------------------------


def all_of_names(nodes: DataFrame) -> DataFrame:
    """Add to every root the properties and required names of its ``allOf`` branches (through local references), nearest first: ``uri, kind, name, from_id, rank``.

    ``rank`` 0 is the root's own; the first writer of a name wins, as a left-biased merge does.
    """
    branches = nodes.filter("parent = '/allOf'").select("uri", "id", F.col("pos").alias("rank"))
    found = lookup_pointer(nodes, branches).join(branches, ["uri", "id"]).select("uri", F.col("found").alias("owner"), (F.col("rank") + 1).alias("rank"))
    owners = found.unionByName(nodes.filter("parent IS NULL").select("uri", F.lit("").alias("owner"), F.lit(0).cast("long").alias("rank")))
    owners = stored(owners.withColumnRenamed("uri", "__uri"), "branches")
    props = nodes.join(owners, (F.col("uri") == F.col("__uri")) & (F.col("parent") == F.concat("owner", F.lit("/properties")))).select("uri", F.lit("property").alias("kind"), F.col("key").alias("name"), F.col("id").alias("from_id"), "rank", "pos")
    names = nodes.join(owners, (F.col("uri") == F.col("__uri")) & (F.col("parent") == F.concat("owner", F.lit("/required")))).select("uri", F.lit("required").alias("kind"), _unquoted(F.col("text")).alias("name"), F.col("id").alias("from_id"), "rank", "pos")
    first = F.row_number().over(Window.partitionBy("uri", "kind", "name").orderBy("rank", "pos"))
    return props.unionByName(names).withColumn("__n", first).filter("__n = 1").select("uri", "kind", "name", "from_id", "rank")


def _definition(pointer: Column) -> Column:
    """The pointer of the root's definition in which a pointer lies; empty outside of them."""
    return F.regexp_extract(pointer, r"^(/(?:\$defs|definitions)/[^/]+)", 1)


def used_definitions(nodes: DataFrame) -> DataFrame:
    """Definitions of the root that something outside of all definitions reaches, through others too: ``uri, name, id`` (the definition's pointer).

    References count as ``#`` with a pointer (percent-encoded or not), by ``$anchor`` or ``$dynamicAnchor``, and by the schema's own ``$id``.
    """
    own = nodes.filter((F.col("parent") == "") & F.col("key").isin("$id", "id") & (F.col("jtype") == "STRING")).groupBy(F.col("uri").alias("src_uri")).agg(F.min(base_of(_unquoted(F.col("text")))).alias("own"))
    edges = meet(ref_edges(nodes), own, ["src_uri"], "left").filter((F.col("base") == "") | (F.col("base") == F.col("own")) | (F.col("base") == F.col("src_uri")))
    edges = edges.select(F.col("src_uri").alias("uri"), "src_path", F.coalesce(F.try_url_decode("fragment"), F.col("fragment"), F.lit("")).alias("to"))
    anchors = nodes.filter(F.col("key").isin("$anchor", "$dynamicAnchor") & (F.col("jtype") == "STRING")).select("uri", _unquoted(F.col("text")).alias("to"), F.col("parent").alias("__at")).distinct()
    named = edges.filter((F.col("to") != "") & ~F.col("to").startswith("/")).join(anchors.hint("merge"), ["uri", "to"]).select("uri", "src_path", F.col("__at").alias("to"))
    steps = edges.filter(F.col("to").startswith("/")).unionByName(named)
    place = lambda pointer: F.concat("uri", F.lit("\u0000"), pointer)
    steps = steps.select(place(_definition(F.col("src_path"))).alias("src_uri"), place(_definition(F.col("to"))).alias("base")).filter(~F.col("base").endswith("\u0000"))
    roots = nodes.select(F.concat("uri", F.lit("\u0000")).alias("uri")).distinct()
    reached = ref_reach(steps, roots).filter(~F.col("uri").endswith("\u0000"))
    found = reached.select(F.split_part("uri", F.lit("\u0000"), F.lit(1)).alias("uri"), F.split_part("uri", F.lit("\u0000"), F.lit(-1)).alias("id"))
    return found.select("uri", F.replace(F.replace(F.substring_index("id", "/", -1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("name"), "id")


def prune_definitions(nodes: DataFrame) -> DataFrame:
    """The nodes without definitions of the root that nothing outside of themselves reaches; a box left empty goes as well. References inside of ``allOf`` count like all others."""
    rows = nodes.withColumn("__def", _definition(F.col("id")))
    used = used_definitions(nodes).select("uri", F.col("id").alias("__def"))
    kept = rows.filter("__def = ''").unionByName(meet(rows.filter("__def <> ''"), used, ["uri", "__def"], "left_semi").select(*rows.columns)).drop("__def")
    full = kept.filter(F.col("parent").isin("/$defs", "/definitions")).select("uri", F.col("parent").alias("id")).distinct()
    boxes = F.col("id").isin("/$defs", "/definitions")
    return kept.filter(~boxes).unionByName(meet(kept.filter(boxes), full, ["uri", "id"], "left_semi").select(*kept.columns))


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _object(keys: Column, text: Callable[[Column], Column]) -> Column:
    """A JSON object of keys and the texts of their values."""
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), text(k))), ","), F.lit("}"))


def merged(a: Column, b: Column) -> Column:
    """The JSON text of two schemas, given as maps, in one: the left one's keywords first, maps of schemas and ``required`` united, flags true if either is."""

    def one(k: Column, x: Column, y: Column) -> Column:
        lists = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda i: F.to_json(i))
        union = lambda m, n: _object(F.array_union(F.map_keys(m), F.map_keys(n)), lambda e: F.to_json(F.coalesce(F.try_element_at(m, e), F.try_element_at(n, e))))
        maps = let(_as_map(x), lambda m: let(_as_map(y), lambda n: union(m, n)))
        united = F.concat(F.lit("["), F.array_join(F.array_union(lists(x), lists(y)), ","), F.lit("]"))
        either = ((F.to_json(x) == "true") | (F.to_json(y) == "true")).cast("string")
        both = F.when(k == "required", united).when(k.isin(*MAPS), maps).when(k.isin(*FLAGS), either)
        return F.when(y.isNull(), F.to_json(x)).when(x.isNull(), F.to_json(y)).otherwise(F.coalesce(both, F.to_json(x)))

    # both maps, and the values of each key, are worked out once, however often the text asks for them
    both = lambda m, n: _object(F.array_union(F.map_keys(m), F.map_keys(n)), lambda k: let(F.try_element_at(m, k), lambda x: let(F.try_element_at(n, k), lambda y: one(k, x, y))))
    return let(a, lambda m: let(b, lambda n: both(m, n)))


def merge_bodies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two schemas of each ``uri`` as one (see :func:`merged`)."""
    parsed = lambda df, n: df.select("uri", _as_map(parse_jsonc(F.col("body"))).alias(n))
    return parsed(left, "a").join(parsed(right, "b"), "uri").select("uri", merged(F.col("a"), F.col("b")).alias("body"))


def flatten_all_of(store: DataFrame) -> DataFrame:
    """``uri, body``: every schema with what its ``allOf`` branches say merged into its root, through local references, in the branches' order.

    ``allOf`` stays as it was; branches hand on neither combinators nor titles and identities; definitions that nothing reaches any more go.
    """
    nodes = schema_nodes(store)
    branches = nodes.filter("parent = '/allOf'").select("uri", "id", "pos")
    found = meet(lookup_pointer(nodes, branches.select("uri", "id")), branches, ["uri", "id"]).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("places"))  # the branches of one schema
    parsed = worked_out(store.select("uri", "body"), v=parse_jsonc(F.col("body"))).select("uri", "v").filter(_as_map(F.col("v")).isNotNull())
    taken = F.transform("places", lambda p: value_at(F.col("v"), p["found"]))
    parts = F.transform(F.filter(taken, lambda v: _as_map(v).isNotNull()), lambda v: F.to_json(v))
    lists = spread(meet(parsed, found, ["uri"], "left")).withColumn("parts", parts)
    clean = lambda j: F.map_filter(_as_map(F.parse_json(j)), lambda k, _: ~k.isin(*OWN))
    body = F.aggregate(F.coalesce("parts", F.array().cast("array<string>")), F.to_json("v"), lambda done, j: merged(_as_map(F.parse_json(done)), clean(j)))
    flat = stored(lists.select("uri", body.alias("body")), "flat-schemas")
    return rebuild(prune_definitions(schema_nodes(flat)))


def bundle_names(nodes: DataFrame, rounds: int = 2) -> DataFrame:
    """What each schema takes into its definitions: ``root, uri, name, hops``; external schemas within ``rounds`` steps. The name is the title, else the URL's last part."""
    edges = ref_edges(nodes).filter("base <> ''")
    edges = edges.withColumn("base", F.when(F.col("base").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("base")).otherwise(url_join(F.col("src_uri"), F.col("base"))))
    reach = ref_closure(edges.filter("base <> src_uri"), rounds=rounds).filter(F.col("uri") != F.col("root"))
    titles = nodes.filter("parent = '' AND key = 'title' AND jtype = 'STRING' AND text <> '\"\"'").select("uri", _unquoted(F.col("text")).alias("title"))
    held = nodes.filter("parent IS NULL").select("uri")
    return meet(meet(reach, held, ["uri"], "left_semi"), titles, ["uri"], "left").select("root", "uri", F.coalesce("title", F.substring_index("uri", "/", -1)).alias("name"), "hops")


def bundle_schemas(store: DataFrame, rounds: int = 2) -> DataFrame:
    """``uri, body``: every schema with the external schemas that it reaches among its own definitions, and references to them rewritten.

    Definitions of a taken schema are taken as well, as its local references mean them. The first writer of a name wins: the schema itself, then by
    steps, definitions before whole schemas, then by URL. A taken schema says where it came from (``x-source``). References to what the store lacks stay.
    """
    nodes = stored(schema_nodes(store), "bundle-nodes")
    names = stored(bundle_names(nodes, rounds), "bundle-names")
    tops = nodes.filter("parent = '/$defs'").select("uri", F.col("key").alias("name"), F.col("id").alias("from_id"))
    whole = names.select("root", "uri", "name", F.lit("").alias("from_id"), "hops", F.lit(1).alias("kind"))
    inner = meet(names.select("root", "uri", "hops"), tops, ["uri"]).select("root", "uri", "name", "from_id", "hops", F.lit(0).alias("kind"))
    own = tops.select(F.col("uri").alias("root"), "name")
    first = F.row_number().over(Window.partitionBy("root", "name").orderBy("hops", "kind", "uri"))
    taken = meet(whole.unionByName(inner), own, ["root", "name"], "left_anti").withColumn("__n", first).filter("__n = 1").drop("__n")
    cells = ["id", "parent", "key", "pos", "jtype", "text"]
    home = F.concat(F.lit("/$defs/"), F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    under = (F.col("id") == F.col("from_id")) | F.startswith(F.col("id"), F.concat("from_id", F.lit("/")))
    moved = lambda c: F.concat(home, F.substring(c, F.length("from_id") + 1, F.length(c)))
    copies = meet(taken, nodes, ["uri"]).filter(under).withColumn("__top", F.col("id") == F.col("from_id"))
    parts = copies.select(
        F.col("root").alias("uri"), moved(F.col("id")).alias("id"), F.when(F.col("__top"), F.lit("/$defs")).otherwise(moved(F.col("parent"))).alias("parent"), F.when(F.col("__top"), F.col("name")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("__top"), F.lit(1_000_000)).otherwise(F.col("pos")).cast("long").alias("pos"), "jtype", "text",
    )
    line = lambda df, id_, parent, k, pos, jtype, text: df.select("uri", id_.alias("id"), parent.alias("parent"), k.alias("key"), F.lit(pos).cast("long").alias("pos"), F.lit(jtype).alias("jtype"), text.cast("string").alias("text"))
    marks = copies.filter(F.col("__top") & (F.col("kind") == 1) & (F.col("jtype") == "OBJECT")).select(F.col("root").alias("uri"), home.alias("h"), _quoted(F.col("uri")).alias("t"))
    parts = parts.unionByName(line(marks, F.concat("h", F.lit("/x-source")), F.col("h"), F.lit("x-source"), 1_000_000, "STRING", F.col("t")))
    missing = meet(taken.select(F.col("root").alias("uri")).distinct(), nodes.filter("id = '/$defs'").select("uri"), ["uri"], "left_anti")
    box = line(missing, F.lit("/$defs"), F.lit(""), F.lit("$defs"), 1_000_000, "OBJECT", F.lit(None))
    out = nodes.select("uri", *cells).unionByName(parts).unionByName(box)
    is_ref = (F.col("key") == "$ref") & (F.col("jtype") == "STRING")
    ref = _unquoted(F.col("text"))
    full = F.when(base_of(ref).rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), base_of(ref)).when(base_of(ref) != "", url_join(F.col("uri"), base_of(ref)))
    out = meet(out.withColumn("__to", F.when(is_ref, full)), names.select(F.col("root").alias("uri"), F.col("uri").alias("__to"), F.col("name").alias("__name")), ["uri", "__to"], "left")
    rest = F.coalesce(fragment_of(ref), F.lit(""))
    new = _quoted(F.concat(F.lit("#/$defs/"), "__name", F.when(rest.startswith("/"), rest).otherwise(F.lit(""))))
    return rebuild(out.withColumn("text", F.when(F.col("__name").isNotNull(), new).otherwise(F.col("text"))).select("uri", *cells))
