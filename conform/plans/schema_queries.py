"""More registered queries: keywords that the first ones leave out, formats, schemas made of rows, catalogs built of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.functions import text as T
from conform.functions import urls as U
from conform.operators import catalog as K
from conform.operators import diagnostics as D
from conform.operators import incremental as I
from conform.operators import resolve as R
from conform.operators import schemagraph as G
from conform.operators import validate as V
from conform.plans.queries import part_schemas, query, t
from conform.plans.stored import shared_path, spread
from conform.sources import catalogs as C
from conform.sources import documents as S


def text(c: str) -> Column:
    return F.col(c).cast("string")


def filled(form: str, **cells: Column) -> Column:
    """A text with ``<name>`` replaced by columns."""
    out = F.lit(form)
    for name, c in cells.items():
        out = F.replace(out, F.lit(f"<{name}>"), c)
    return out


# -- keywords ---------------------------------------------------------------

KEYWORDS = {
    "patternProperties": {"^k_[cp]": {"maximum": 50}}, "propertyNames": {"maxLength": 7}, "minProperties": 4, "dependentRequired": {"user": ["session"]}, "dependentSchemas": {"user": {"properties": {"tags": {"maxItems": 2}}}},
    "properties": {"never": False, "tags": {"items": [{"type": "string"}, {"type": "number"}], "additionalItems": False}, "blob": {"contentEncoding": "base64", "contentMediaType": "application/json"}},
}


@query("""
WITH v AS (
SELECT '/k_' || event_type AS instance_path, 'maximum' AS kind FROM events WHERE event_type IN ('click', 'purchase') AND value > 50
UNION ALL SELECT '', 'property_names' FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL SELECT '', 'min_properties' FROM events WHERE event_type NOT IN ('click', 'error')
UNION ALL SELECT '', 'required' FROM events WHERE event_type = 'click'
UNION ALL SELECT '/tags', 'max_items' FROM events WHERE event_type = 'click'
UNION ALL SELECT '/never', 'false_schema' FROM events WHERE event_type = 'error'
UNION ALL SELECT '/tags', 'additional_items' FROM events
UNION ALL SELECT '/blob', 'content_encoding' FROM events WHERE event_type NOT IN ('view', 'signup')
UNION ALL SELECT '/blob', 'content_media_type' FROM events WHERE event_type = 'signup')
SELECT instance_path, kind, count(*) AS n FROM v GROUP BY ALL
""")
def events_object_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    blob = F.when(kind == "view", F.base64(F.col("props").cast("binary"))).when(kind == "signup", F.lit("ew==")).otherwise(F.lit("***"))
    extra = F.when(kind == "click", F.lit(', "user": 1')).when(kind == "error", F.lit(', "never": 1')).otherwise(F.lit(""))
    content = filled('{"k_<kind>": <value>, "tags": ["<kind>", <value>, <user>], "blob": "<blob>"<extra>}', kind=kind, value=text("value"), user=text("user_id"), blob=blob, extra=extra)
    docs = t(spark, sf_dir, "events").select("event_id", S.parse_jsonc(content).alias("instance"))
    return D.counts_by(V.validate_one(docs, KEYWORDS, ["event_id"]), "instance_path", "kind")


@query("SELECT event_id, CASE WHEN value > 50 THEN 2 ELSE 1 END AS left_over FROM events")
def events_unevaluated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"prefixItems": [{"type": "string"}], "anyOf": [{"prefixItems": [True, {"type": "number", "maximum": 50}]}, {"type": "array"}], "unevaluatedItems": {"type": "boolean"}}
    rows = spread(t(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id"))
    docs = rows.select("event_id", S.parse_jsonc(filled('["<kind>", <value>, <user>]', kind=F.col("event_type"), value=text("value"), user=text("user_id"))).alias("instance"))
    found = V.validate_one(docs, schema, ["event_id"]).filter("kind = 'unevaluated_items'")
    return found.select("event_id", F.size(F.split(F.col("params")["unexpected"], ", ")).alias("left_over"))


@query("SELECT p_partkey, repeat('/c', p_size % 25) || '/size' AS instance_path, 'maximum' AS kind FROM part WHERE p_size > 40")
def part_deep_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 24 levels under a recursive schema, the value at the end of twelve references."""
    schema = {"$defs": {f"s{i}": {"$ref": f"#/$defs/s{i + 1}"} for i in range(12)} | {"s12": {"type": "integer", "maximum": 40}}, "properties": {"c": {"$ref": "#"}, "size": {"$ref": "#/$defs/s0"}}, "additionalProperties": False}
    depth = (F.col("p_size") % 25).cast("int")
    content = F.concat(F.repeat(F.lit('{"c":'), depth), F.lit('{"size":'), text("p_size"), F.repeat(F.lit("}"), depth + 1))
    docs = t(spark, sf_dir, "part").select("p_partkey", S.parse_jsonc(content).alias("instance"))
    return V.validate_one(docs, schema, ["p_partkey"]).select("p_partkey", "instance_path", "kind")


@query("""
SELECT event_id, '/' || k AS instance_path, 'Additional properties are not allowed (''' || k || ''' was unexpected)' || hint AS message FROM events,
 (VALUES ('valeu', '; did you mean ''value''?'), ('kinds', '; did you mean ''kind''?'), ('zzzzzz', '')) h(k, hint) WHERE k <> 'kinds' OR event_type = 'click'
""")
def events_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"$defs": {"base": {"properties": {"kind": True}}}, "allOf": [{"$ref": "#/$defs/base"}], "properties": {"value": True}, "additionalProperties": False}
    content = F.concat(F.lit('{"value": 1, "valeu": 2, "zzzzzz": 3'), F.when(F.col("event_type") == "click", F.lit(', "kinds": 4')).otherwise(F.lit("")), F.lit("}"))
    docs = t(spark, sf_dir, "events").select("event_id", S.parse_jsonc(content).alias("instance"))
    return V.validate_one(docs, schema, ["event_id"]).select("event_id", "instance_path", "message")


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def documents_commented_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts inside JSON with comments and a trailing comma."""
    pair = F.to_json(F.struct("text"))
    content = F.concat(F.lit("{ // note\n"), F.substring(pair, F.lit(2), F.length(pair) - 2), F.lit(", /* end */ }"))
    back = F.try_variant_get(S.parse_jsonc(content), "$.text", "string")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("digest"), F.length(back).cast("long").alias("n"))


# -- formats and what they name ---------------------------------------------

_URI = "https://s.example/"


@query("""
SELECT page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN 'jsonc' WHEN 1 THEN 'yaml' WHEN 2 THEN 'toml' ELSE 'markdown' END AS format, page_id AS id FROM pages WHERE page_id % 5 < 4
""")
def pages_any_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose names mean no format; one in five is none of them."""
    forms = F.array(*[F.lit(x) for x in ('{"id": <id>,}', "id: <id>\n", "id = <id>\n", "---\nid: <id>\n---\n# Words\n", "words and <id>")])
    content = F.replace(F.element_at(forms, (F.col("page_id") % 5 + 1).cast("int")), F.lit("<id>"), text("page_id"))
    docs = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("p/"), text("page_id"), F.lit(".page")).alias("path"), content.alias("content"))
    return S.normalize_documents(docs, F.lit(True)).select("doc_id", "format", F.try_variant_get("instance", "$.id", "long").alias("id"))


@query(f"""
SELECT page_id AS doc_id, CASE page_id % 6 WHEN 5 THEN NULL ELSE '{_URI}' || page_id END AS uri FROM pages
""")
def pages_inline_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in a property, a modeline among comments, and two kinds of comment; TOML has none in a property."""
    cases = [("jsonc", '{"$schema": "<u>"}'), ("yaml", "# one\n\n# yaml-language-server: $schema=<u>\na: 1\n"), ("yaml", '"$schema": <u>\n'), ("toml", "# one\n# :schema <u>\na = 1\n"), ("toml", "# $schema: <u>\n"), ("toml", '"$schema" = "<u>"\n')]
    one = F.element_at(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for f, c in cases]), (F.col("page_id") % len(cases) + 1).cast("int"))
    rows = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), one.alias("x"), F.concat(F.lit(_URI), text("page_id")).alias("u"))
    content = F.replace(F.col("x.c"), F.lit("<u>"), F.col("u"))
    value = F.when((F.col("x.f") == "jsonc"), F.try_parse_json(content)).when(F.col("doc_id") % 6 == 2, F.parse_json(F.concat(F.lit('{"$schema": "'), "u", F.lit('"}')))).otherwise(F.parse_json(F.lit('{"$schema": "never"}')))
    value = F.when((F.col("x.f") == "yaml") & (F.col("doc_id") % 6 == 1), F.parse_json(F.lit("{}"))).otherwise(value)
    return rows.select("doc_id", S.inline_schema(F.col("x.f"), content, value).alias("uri"))


@query("""
WITH d AS (SELECT CASE WHEN page_id % 7 = 0 THEN 'null' WHEN page_id % 7 = 1 THEN 'no schema' END AS reason, page_id % 3 AS s FROM pages)
SELECT reason AS name, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'schema ' || s, count(*) FROM d WHERE reason IS NULL GROUP BY 1
""")
def pages_skipped_and_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    docs = t(spark, sf_dir, "pages").select(k, F.parse_json(F.when(k % 7 == 0, "null").otherwise("{}")).alias("instance"), F.when(k % 7 != 1, F.concat(F.lit("schema "), (k % 3).cast("string"))).alias("schema_uri"))
    fine, skipped = S.checkable(docs)
    return skipped.select(F.col("reason").alias("name"), "n").unionAll(S.group_sizes(fine))


@query("""
SELECT page_id AS doc_id, CASE page_id % 4 WHEN 0 THEN 'conf/s.json' WHEN 1 THEN 'd/' || page_id || '/s.json' WHEN 2 THEN 'conf/s.json' ELSE 'https://h.example/s.json' END AS uri, page_id % 4 = 3 AS remote FROM pages
""")
def pages_schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    uri = F.element_at(F.array(F.lit("//s.json"), F.lit("./s.json"), F.lit("x/../s.json"), F.lit("https://h.example/s.json")), (k % 4 + 1).cast("int"))
    found = R.resolve_uri_path(uri, F.concat(F.lit("d/"), k.cast("string"), F.lit("/f.json")), F.when(k % 4 == 1, "inline").otherwise("catalog"), "conf")
    return t(spark, sf_dir, "pages").select(k.alias("doc_id"), found.alias("uri"), U.is_remote(found).alias("remote"))


# -- schemas made of rows ---------------------------------------------------


def _uri(shift: int = 0) -> Column:
    return F.concat(F.lit("https://parts.example/"), (F.col("p_partkey") + shift).cast("string"), F.lit(".json"))


def _schemas(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """A schema for each part, from a form with ``<k>, <next>, <size>, <name>``."""
    cells = {"k": text("p_partkey"), "next": (F.col("p_partkey") + 7).cast("string"), "size": text("p_size"), "name": F.col("p_name")}
    return t(spark, sf_dir, "part").select(_uri().alias("uri"), filled(form, **cells).alias("body"))


_P = "WITH p AS (SELECT *, 'https://parts.example/' || p_partkey || '.json' AS uri, EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey + 7) AS has1, EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey + 14) AS has2 FROM part)\n"
_CHAIN = '{"properties":{"next":{"$ref":"<next>.json"},"q":{"$ref":"#/$defs/own"}},"$defs":{"own":{"const":<k>}}}'


@query(_P + """SELECT uri, CASE WHEN has1 THEN '#/$defs/' || (p_partkey + 7) || '.json' ELSE (p_partkey + 7) || '.json' END AS next_ref, 1 + has1::INT + (has1 AND has2)::INT AS definitions, p_partkey AS own FROM p""")
def schema_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each schema with the two next ones in its definitions; its own definition wins over those of the same name."""
    v = F.parse_json("body")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    names = F.map_keys(at('$["$defs"]', "map<string,variant>"))
    return G.bundle_schemas(_schemas(spark, sf_dir, _CHAIN)).select("uri", at('$.properties.next["$ref"]', "string").alias("next_ref"), F.size(names).alias("definitions"), at('$["$defs"].own.const', "long").alias("own"))


_FLAT = '{"title":"<name>","properties":{"a":{"maximum":<size>}},"required":["a"],"allOf":[{"$ref":"#/$defs/d"},{"title":"x","properties":{"a":{"maximum":0},"c":{}},"required":["c","a"],"readOnly":true}],"$defs":{"d":{"properties":{"b":{"$ref":"#/$defs/e"}},"required":["b"]},"e":{"const":<k>},"lost":{"$ref":"#/$defs/e"}}}'


@query(_P + """SELECT uri, p_name AS title, 'a,b,c' AS names, '["a","b","c"]' AS required, CAST(p_size AS BIGINT) AS most, 'd,e' AS kept, true AS read_only FROM p""")
def schema_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json("body")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    keys = lambda path: F.array_join(F.array_sort(F.map_keys(at(path, "map<string,variant>"))), ",")
    flat = G.flatten_all_of(_schemas(spark, sf_dir, _FLAT))
    return flat.select("uri", at("$.title", "string").alias("title"), keys("$.properties").alias("names"), F.to_json(at("$.required", "variant")).alias("required"), at("$.properties.a.maximum", "long").alias("most"), keys('$["$defs"]').alias("kept"), at("$.readOnly", "boolean").alias("read_only"))


@query(_P + """SELECT uri, 'a' AS name FROM p UNION ALL SELECT uri, 'b' FROM p UNION ALL SELECT uri, 'c' FROM p""")
def schema_property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.schema_nodes(_schemas(spark, sf_dir, _FLAT))
    return G.property_names_at(nodes, nodes.filter("parent IS NULL").select("uri", "id")).select("uri", "name")


@query(_P + """SELECT uri, '/properties/q' AS id, '/$defs/t' AS found FROM p UNION ALL SELECT uri, '/$defs/t', '/$defs/t' FROM p""")
def schema_pointer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through two references; two that refer to each other lead nowhere."""
    nodes = G.schema_nodes(_schemas(spark, sf_dir, '{"properties":{"q":{"$ref":"#/$defs/s"},"r":{"$ref":"#/$defs/x"}},"$defs":{"s":{"$ref":"#/$defs/t"},"t":{"const":<k>},"x":{"$ref":"#/$defs/y"},"y":{"$ref":"#/$defs/x"}}}'))
    return G.lookup_pointer(nodes, nodes.filter(F.col("id").isin("/properties/q", "/properties/r", "/$defs/t")).select("uri", "id"))


@query(_P + """SELECT uri AS src_uri, src_path, ref FROM p, LATERAL (VALUES ('/properties/size', uri || '#/definitions/size'), ('/properties/next', CASE WHEN has1 THEN 'part-' || (p_partkey + 7) ELSE 'https://parts.example/' || (p_partkey + 7) || '.json' END || '#/definitions/size')) r(src_path, ref)""")
def schema_refs_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases replaced where a target is known, then local references made absolute."""
    parts = t(spark, sf_dir, "part")
    nodes = G.schema_nodes(part_schemas(spark, sf_dir))
    ids = parts.select(_uri().alias("uri"), F.concat(F.lit('"'), _uri(), F.lit('"')).alias("text"))
    nodes = G.patch_root(G.rewrite_refs(nodes, parts.select(_uri().alias("base"), F.concat(F.lit("part-"), text("p_partkey")).alias("target"))), "$id", ids)
    return G.ref_edges(G.absolute_refs(nodes)).select("src_uri", "src_path", "ref")


@query(_P + """SELECT uri AS src_uri, uri || '#/$defs/own' AS resolved, NULL AS canonical FROM p UNION ALL SELECT uri, 'https://parts.example/' || (p_partkey + 7) || '.json', CASE WHEN has1 THEN 'https://canonical.example/' || (p_partkey + 7) END FROM p""")
def schema_sibling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative references made absolute, and those to members of the same group."""
    parts = t(spark, sf_dir, "part")
    edges = G.ref_edges(G.schema_nodes(_schemas(spark, sf_dir, _CHAIN))).withColumn("group", F.lit("g"))
    edges = G.resolve_relative_refs(edges, parts.select(_uri().alias("uri"), _uri().alias("canonical"))).drop("canonical")
    members = parts.select(F.lit("g").alias("group"), text("p_partkey").alias("key"), F.concat(F.lit("https://canonical.example/"), text("p_partkey")).alias("canonical"))
    return G.sibling_refs(edges, members).select("src_uri", "resolved", "canonical")


@query(_P + """SELECT 'fetch' AS what, 'https://parts.example/' || (p_partkey + 7) || '.json' AS uri FROM p WHERE NOT has1 UNION ALL SELECT 'external', 'https://parts.example/' || (p_partkey + 7) || '.json' FROM p""")
def schema_refs_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = part_schemas(spark, sf_dir)
    edges = G.ref_edges(G.schema_nodes(store))
    return G.refs_to_fetch(edges, store).select(F.lit("fetch").alias("what"), "uri").unionAll(G.external_refs(edges).select(F.lit("external").alias("what"), F.col("base").alias("uri")))


@query(_P + """SELECT uri, path, message FROM p, (VALUES ('/properties/a', 'expected a schema'), ('/allOf', 'expected an array of schemas'), ('/$defs', 'expected an object of schemas'), ('/required', 'expected an array'), ('/type', 'expected a type name or an array of them')) e(path, message) WHERE p_size % 2 = 0""")
def schema_shape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = '{"properties":{"a":<size>},"allOf":{},"$defs":[],"required":"x","type":1}'
    return G.shape_errors(G.schema_nodes(_schemas(spark, sf_dir, wrong).withColumn("body", F.when(F.substring_index(F.split_part("body", F.lit('"a":'), F.lit(2)), "}", 1).cast("int") % 2 == 0, F.col("body")).otherwise(F.lit("true")))))


@query(_P + """SELECT uri, '^' || chr(92) || '{x' || p_size || chr(92) || '}$' AS pattern, '^[0-9-x]$' AS pattern_key, true AS deprecated, false AS extra, '#/$defs/a' AS ref, 'a,b' AS definitions FROM p""")
def schema_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns repaired as text, texts for booleans, a namespace among the definitions; twice, as the second run changes nothing."""
    body = '{"$schema":"http://json-schema.org/draft-07/schema#","pattern":"^{x<size>}$","patternProperties":{"^[\\\\d-x]$":{"title":null}},"deprecated":"old","additionalProperties":"false","properties":{"q":{"$ref":"#/definitions/ns/a"}},"definitions":{"ns":{"a":{"type":"string"},"b":true}}}'
    v = F.parse_json("body")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    keys = lambda path: F.array_join(F.array_sort(F.map_keys(at(path, "map<string,variant>"))), ",")
    return G.migrate_schemas(G.migrate_schemas(_schemas(spark, sf_dir, body))).select("uri", at("$.pattern", "string").alias("pattern"), keys("$.patternProperties").alias("pattern_key"), at("$.deprecated", "boolean").alias("deprecated"), at("$.additionalProperties", "boolean").alias("extra"), at('$.properties.q["$ref"]', "string").alias("ref"), keys('$["$defs"]').alias("definitions"))


_SHAPES = '{"properties":{"v":{"oneOf":[{"title":"One"},{"$ref":"#/$defs/k"},{"type":"null"}]},"w":{"type":"array","items":{"type":"array","items":{"type":"string"}},"examples":[<size>,"x"]},"m":{"type":"object","additionalProperties":{"enum":[1]}}},"required":["w"],"$defs":{"k":{"const":<k>}}}'


@query(_P + """
SELECT uri, what, owner, name, label FROM p, LATERAL (VALUES
 ('property', '', 'v', 'k | null'), ('property', '', 'w', 'string[][]'), ('property', '', 'm', 'object'), ('variant', '/properties/v', 'oneOf', 'One'), ('variant', '/properties/v', 'oneOf', 'k'), ('variant', '/properties/v', 'oneOf', 'null'),
 ('definition', '', 'k', 'const: ' || p_partkey), ('example', '/properties/w', 'examples', p_size::VARCHAR), ('example', '/properties/w', 'examples', '"x"'),
 ('inner', '/properties/w', 'items', 'string[]'), ('inner', '/properties/w/items', 'items', 'string'), ('inner', '/properties/m', 'additionalProperties', 'enum')) r(what, owner, name, label)""")
def schema_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.schema_nodes(_schemas(spark, sf_dir, _SHAPES))
    labels = K.type_labels(nodes)
    row = lambda df, what, owner, name, label: df.select("uri", F.lit(what).alias("what"), owner.alias("owner"), name.alias("name"), label.alias("label"))
    c = F.col
    parts = [
        row(K.schema_properties(nodes, labels=labels), "property", c("owner"), c("name"), c("label")), row(K.schema_variants(nodes, labels), "variant", c("owner"), c("keyword"), c("label")), row(K.schema_definitions(nodes, labels), "definition", F.lit(""), c("name"), c("label")),
        row(K.schema_examples(nodes), "example", c("owner"), F.lit("examples"), c("value")), row(K.additional_and_items(nodes, labels), "inner", c("owner"), c("keyword"), c("label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query(_P + """
SELECT uri, name, label, required, CAST(errors AS BIGINT) AS errors FROM p, LATERAL (VALUES ('v', 'k | null', false, (p_size % 2 = 0)::INT), ('w', 'string[][]', true, 2 * (p_size > 25)::INT), ('m', 'object', false, 0)) r(name, label, required, errors)""")
def schema_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with the errors under them; errors of the same path under another schema do not count."""
    rows = t(spark, sf_dir, "part")
    paths = F.concat(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("/v"), F.lit("/vv"))).otherwise(F.array().cast("array<string>")), F.when(F.col("p_size") > 25, F.array(F.lit("/w"), F.lit("/w/0"))).otherwise(F.array().cast("array<string>")))
    errors = rows.select(_uri().alias("schema_uri"), F.explode(paths).alias("instance_path")).unionAll(rows.select(F.lit("other").alias("schema_uri"), F.lit("/m").alias("instance_path")))
    return K.explain(G.schema_nodes(_schemas(spark, sf_dir, _SHAPES)), errors, "")


@query(_P + """SELECT p_partkey, '' AS instance_path, 'maximum' AS kind FROM p WHERE p_size > 30 AND p_size % 10 <> 3 UNION ALL SELECT p_partkey, NULL, 'schema_fetch' FROM p WHERE p_size % 10 = 3""")
def part_store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the schemas of a stored table; one schema refers to another, one is missing."""
    store = C.schema_store(spark, {"a": {"$ref": "b"}, "b": {"type": "integer", "maximum": 30}, "unused": False})
    uri = F.when(F.col("p_size") % 10 == 3, "lost").when(F.col("p_size") % 2 == 0, "a").otherwise("b")
    docs = t(spark, sf_dir, "part").select("p_partkey", text("p_partkey").alias("path"), uri.alias("schema_uri"), F.parse_json(text("p_size")).alias("instance"))
    schemas = V.schemas_of(docs, store)
    found = V.validate(docs, schemas, ["p_partkey"]).select("p_partkey", "instance_path", "kind")
    return found.unionAll(V.schema_findings(docs, schemas).select(F.col("path").cast("long"), F.lit(None).cast("string"), "code"))


@query("""
WITH d AS (SELECT o_orderpriority || o_orderstatus AS content, o_orderstatus = 'F' AS old FROM orders), k AS (SELECT content, bool_or(old) AS old FROM d GROUP BY 1)
SELECT CASE WHEN k.old THEN 'hit' ELSE 'miss' END AS status, count(*) AS n, sum(length(content)) AS errors FROM d JOIN k USING (content) GROUP BY 1
""")
def orders_incremental_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are written by a run that is then repeated, read back, and used for all documents."""
    docs = t(spark, sf_dir, "orders").select("o_orderstatus", F.concat("o_orderpriority", "o_orderstatus").alias("content")).withColumn("cache_key", I.cache_key(F.col("content"), F.lit("s"), F.lit(True)))
    check = lambda df: df.select("cache_key", F.array(F.length("content").cast("string")).alias("errors"))
    path = shared_path(spark, "results")
    for _ in range(2):
        I.store_results(check(docs.filter("o_orderstatus = 'F'").dropDuplicates(["cache_key"])), path, "first")
    done, _ = I.incremental_validate(docs, I.load_results(spark, path), check)
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("errors")[0].cast("long")).alias("errors"))


# -- catalogs built of rows -------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(k.alias("entry_ord"), text("p_partkey").alias("key"), _uri().alias("url"), F.col("p_name").alias("title"), F.concat("p_type", F.lit("\nmore")).alias("schema_description"),
        F.when(k % 3 == 0, F.col("p_brand")).alias("config_name"), F.when(k % 3 == 1, F.col("p_brand")).alias("meta_name"), F.lit(None).cast("string").alias("config_description"), F.when(k % 2 == 0, F.lit("meta")).alias("meta_description"),
        F.when(k % 4 == 0, F.array(F.lit("*.yml"), F.lit("x.toml"))).alias("catalog_match"), F.when(k % 4 == 1, F.array(F.lit("m.json5"))).alias("meta_match"), F.when(k % 4 == 2, F.array(F.lit("r.md"), F.lit("noext"))).alias("root_match"), "p_size", "p_brand")


@query("""
SELECT p_partkey AS entry_ord, CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE p_name END AS entry_name, CASE WHEN p_partkey % 2 = 0 THEN 'meta' ELSE p_type END AS entry_description,
 CASE p_partkey % 4 WHEN 0 THEN '*.yml,x.toml' WHEN 1 THEN 'm.json5' WHEN 2 THEN 'r.md,noext' ELSE '' END AS globs, CASE p_partkey % 4 WHEN 0 THEN 'toml,yaml' WHEN 1 THEN 'json5' WHEN 2 THEN 'markdown' ELSE '' END AS parsers FROM part
""")
def catalog_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.with_defaults(_entries(spark, sf_dir))
    return rows.select("entry_ord", "entry_name", "entry_description", F.array_join("entry_match", ",").alias("globs"), F.array_join(K.parsers_of(F.col("entry_match")), ",").alias("parsers"))


@query(_P + """SELECT uri AS url, sha256('{"s":' || p_size || '}') AS digest, p_size % 5 = 0 AS invalid, '' AS parsers FROM p""")
def catalog_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that come of what cannot be fetched leave a schema valid."""
    rows = t(spark, sf_dir, "part")
    entries = rows.select(_uri().alias("url"), F.lit("s").alias("source_url"), filled('{"s":<n>}', n=text("p_size")).alias("body"), F.array(F.lit("plain")).alias("file_match"), F.col("p_name").alias("description"))
    errors = rows.filter("p_size % 5 = 0").select(_uri().alias("uri"), F.lit("bad regex").alias("message")).unionAll(rows.filter("p_size % 5 = 1").select(_uri().alias("uri"), F.lit("'/x' does not exist").alias("message")))
    return K.with_provenance(entries, errors).select("url", "provenance.source_sha256", F.col("provenance.invalid").alias("invalid"), F.array_join("provenance.parsers", ",").alias("parsers")).withColumnRenamed("source_sha256", "digest")


@query("SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size % 2 = 0 THEN '1.10.0' ELSE 'b' END AS version FROM part")
def catalog_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers compare as versions, other texts as texts; the highest whose body is the latest's."""
    rows = t(spark, sf_dir, "part")
    key, even = text("p_partkey"), F.col("p_size") % 2 == 0
    named = lambda *vs: F.create_map(*[x for v in vs for x in (F.lit(v), F.concat(key, F.lit("/" + v)))])
    entries = rows.select(key.alias("name"), _uri().alias("url"), F.when(even, named("1.2.0", "1.10.0", "2.0.0")).otherwise(named("10", "b", "c")).alias("versions"))
    bodies = entries.select(F.col("url").alias("uri"), F.lit("B").alias("body")).unionAll(entries.select(F.explode("versions").alias("v", "uri")).select("uri", F.when(F.col("v").isin("2.0.0", "c"), "other").otherwise("B")))
    return K.latest_versions(entries, bodies)


@query("""
SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size = 1 THEN 'one' WHEN p_size % 10 = 0 THEN 'ten' ELSE 'src' END AS dir, NULL AS message FROM part WHERE p_size % 20 <> 0
UNION ALL SELECT p_partkey::VARCHAR, NULL, 'matches several folders: ten, twenty' FROM part WHERE p_size % 20 = 0
""")
def catalog_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("one", "url", "https://parts.example/size/1"), ("ten", "match", "a**.ten"), ("twenty", "match", "**.twenty**")], "dir string, kind string, pattern string")
    size = F.col("p_size")
    match = F.when(size % 20 == 0, F.array(F.lit("a/x.ten"), F.lit("b.twenty/y"))).when(size % 10 == 0, F.array(F.lit("q"), F.lit("a/b/c.ten"))).otherwise(F.array(F.lit("x.ten")))
    entries = t(spark, sf_dir, "part").select(text("p_partkey").alias("name"), F.concat(F.lit("https://parts.example/size/"), size.cast("string")).alias("url"), match.alias("file_match"))
    fine, several = K.classify_entries(entries, rules, "src")
    return fine.select("name", "dir", F.lit(None).cast("string").alias("message")).unionAll(several.select("name", F.lit(None).cast("string"), "message"))


@query("""
WITH e AS (SELECT p_brand AS url, min(p_partkey) AS first FROM part GROUP BY 1), f AS (SELECT url, row_number() OVER (ORDER BY first) - 1 AS entry_ord FROM e)
SELECT CAST(entry_ord AS BIGINT) AS entry_ord, url, CASE WHEN entry_ord = 0 THEN 'same.json' ELSE 'same-' || (entry_ord + 1) || '.json' END AS file FROM f
""")
def catalog_united_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources with repeated URLs, counted on; equal file names numbered."""
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_ord"), F.col("p_brand").alias("url"))
    united = K.united_entries([K.first_entries(rows), K.source_entries(rows)]).select(F.col("entry_ord").cast("long").alias("entry_ord"), "url")
    named = K.unique_filenames(united.withColumns({"folder": F.lit("f"), "u": F.lit("https://h/same")}), "folder", "u", "entry_ord")
    return named.select("entry_ord", "url", "file")


@query("""
SELECT p_type AS "group", count(*) AS n, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR)) AS members FROM part WHERE p_size > 10 GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL FROM part WHERE p_size <= 10
""")
def catalog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part")
    members, left = K.groups_of(rows.select(text("p_partkey").alias("name")), rows.filter("p_size > 10").select(F.col("p_type").alias("group"), text("p_partkey").alias("name")))
    return members.select("group", "n", F.md5(F.array_join("schemas", ",").cast("binary")).alias("members")).unionAll(left.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(None).cast("string"), "n", F.lit(None).cast("string")))


@query(_P + """SELECT uri, '{"$schema":"s","$id":"' || uri || '","title":"' || p_name || '","type":"object","zz":1,"aa":2}' AS body FROM p""")
def schema_root_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root's own URL set, known keywords first, the others as they came."""
    nodes = G.schema_nodes(_schemas(spark, sf_dir, '{"zz":1,"type":"object","aa":2,"title":"<name>","$id":"old","$schema":"s"}'))
    # VARIANT keeps keys in order of their names, so the others' order is given here
    nodes = nodes.withColumn("pos", F.when(F.col("key") == "zz", 0).when(F.col("key") == "aa", 1).otherwise(F.col("pos")))
    ids = t(spark, sf_dir, "part").select(_uri().alias("uri"), F.concat(F.lit('"'), _uri(), F.lit('"')).alias("text"))
    return G.rebuild(K.root_key_order(G.patch_root(nodes, "$id", ids)))


@query("""
SELECT s_suppkey, 'here in /type' AS label, 'a/b~' || s_suppkey AS decoded, '/properties/a/items/properties/k' || s_suppkey AS pointer, '/a/k' || s_suppkey AS prefix, upper(substr(s_name, 1, 1)) || substr(s_name, 2) AS titled,
 s_name AS first, 'x#/a%20b/%7B' || s_suppkey || '%7D' AS encoded, CASE WHEN s_suppkey % 3 = 0 THEN true WHEN s_suppkey % 3 = 1 THEN false END AS flag, CAST(strlen(s_name) + 3 AS INT) AS place, s_suppkey % 10 = 7 AS under, s_name LIKE '%7' AS ends FROM supplier
""")
def supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, lit = text("s_suppkey"), F.col("s_name"), F.lit
    flag = F.element_at(F.array(lit("true"), lit("false"), lit("yes")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    path = F.concat(lit("/a/"), (F.col("s_suppkey") % 10).cast("string"), lit("/b"))
    from conform.functions.globs import glob_match

    rows = t(spark, sf_dir, "supplier").withColumn("instance_path", path)
    under = V.violations_under(rows, "/a/7").select("s_suppkey", lit(True).alias("under"))
    out = rows.select(
        "s_suppkey", T.label(lit(""), lit("/type")).alias("label"), T.pointer_decode(F.concat(lit("a~1b~0"), k)).alias("decoded"), T.to_schema_pointer(F.concat(lit("$.a[0].k"), k)).alias("pointer"),
        T.instance_prefix(F.concat(lit("/properties/a/items/properties/k"), k)).alias("prefix"), T.title_case(name).alias("titled"), T.first_line(F.concat(name, lit("\nmore"))).alias("first"), T.encode_fragment(F.concat(lit("x#/a b/{"), k, lit("}"))).alias("encoded"),
        T.string_to_bool(flag).alias("flag"), T.line_col_offset(F.concat(name, lit("\nab\n")), lit(2), lit(3)).cast("int").alias("place"), glob_match(F.upper(name), "supplier*7", ignore_case=True).alias("ends"),
    )
    return out.join(under, "s_suppkey", "left").withColumn("under", F.coalesce("under", lit(False)))
