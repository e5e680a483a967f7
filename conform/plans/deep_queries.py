"""Registered queries over what one expression, one literal or one join does not reach: recursion, exact numbers, drafts, many schemas, indexes of patterns and names, broken JSON, nested settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.functions import urls as U
from conform.functions.globs import escape_glob, pattern_rows
from conform.operators import annotate as A
from conform.operators import catalog as K
from conform.operators import resolve as R
from conform.operators import schemagraph as G
from conform.operators import stats
from conform.operators import validate as V
from conform.plans.queries import query, t
from conform.plans.schema_queries import filled, text
from conform.plans.stored import numbered, shared_path, spread
from conform.sources import catalogs as C
from conform.sources import documents as S


def nested(opening: Column, leaf: Column, closing: str, depth: Column) -> Column:
    """A JSON text with a leaf inside of ``depth`` brackets."""
    return F.concat(F.repeat(opening, depth), leaf, F.repeat(F.lit(closing), depth))


#: Ten places that all refer back to the root.
TEN = {"type": "object", "properties": {f"p{i}": {"$ref": "#"} for i in range(10)} | {"v": {"type": "integer", "maximum": 40}}}


@query("""
WITH d AS (SELECT p_partkey, p_size, repeat('/p' || p_partkey % 10, (p_partkey % 31)::INT) AS place FROM part)
SELECT p_partkey, place || '/v' AS instance_path, CASE WHEN p_size % 2 = 0 THEN 'type' ELSE 'maximum' END AS kind FROM d WHERE p_size % 2 = 0 OR p_size > 40
""")
def deep_recursive_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema with ten recursive places over documents up to 30 levels deep."""
    k = F.col("p_partkey")
    leaf = F.concat(F.lit('{"v":'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), text("p_size"), F.lit('"'))).otherwise(text("p_size")), F.lit("}"))
    content = nested(F.concat(F.lit('{"p'), (k % 10).cast("string"), F.lit('":')), leaf, "}", (k % 31).cast("int"))
    return V.validate_one(t(spark, sf_dir, "part").select("p_partkey", F.parse_json(content).alias("instance")), TEN, ["p_partkey"]).select("p_partkey", "instance_path", "kind")


#: Branches below the recursion.
BRANCHES = {
    "any": {"anyOf": [{"type": "integer"}, {"type": "object", "properties": {"c": {"$ref": "#"}}}]},
    "one": {"oneOf": [{"type": "integer"}, {"type": "object", "properties": {"c": {"$ref": "#"}}, "required": ["c"]}]},
    "not": {"not": {"type": "object", "properties": {"c": {"$ref": "#"}}, "required": ["c"]}},
    "if": {"if": {"properties": {"c": {"$ref": "#"}}, "required": ["c"]}, "then": {"required": ["t"]}},
    "has": {"type": ["array", "integer"], "contains": {"$ref": "#"}},
    "left": {"$ref": "#/$defs/n", "$defs": {"n": {"anyOf": [{"type": "integer"}, {"properties": {"c": {"$ref": "#/$defs/n"}}}], "unevaluatedProperties": False}}},
}


@query("""
WITH d AS (SELECT p_partkey, p_size % 3 = 0 AS bad, p_partkey // 6 % 12 AS depth, ['any', 'one', 'not', 'if', 'has', 'left'][p_partkey % 6 + 1] AS uri FROM part)
SELECT p_partkey, '' AS instance_path, CASE uri WHEN 'any' THEN 'any_of' WHEN 'one' THEN 'one_of_not_valid' WHEN 'has' THEN CASE WHEN depth = 0 THEN 'type' ELSE 'contains' END ELSE 'any_of' END AS kind FROM d WHERE bad AND uri IN ('any', 'one', 'has')
UNION ALL SELECT p_partkey, '', CASE uri WHEN 'not' THEN 'not' ELSE 'required' END FROM d WHERE uri IN ('not', 'if') AND depth % 2 = 1
UNION ALL SELECT p_partkey, '', 'unevaluated_properties' FROM d WHERE uri = 'left' AND bad
UNION ALL SELECT p_partkey, '', 'any_of' FROM d WHERE uri = 'left' AND bad AND depth > 0
""")
def deep_recursive_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``anyOf``, ``oneOf``, ``not``, ``if``, ``contains`` and ``unevaluatedProperties`` decided by values up to 11 levels below."""
    k, bad = F.col("p_partkey"), F.col("p_size") % 3 == 0
    uri = F.element_at(F.array(*[F.lit(u) for u in ("any", "one", "not", "if", "has", "left")]), (k % 6 + 1).cast("int"))
    depth = F.floor(k / 6 % 12).cast("int")
    leaf = F.when((uri == "left") & bad, F.lit('{"d":1}')).when(bad, F.lit('"x"')).otherwise(F.lit("7"))
    content = F.when(uri == "has", nested(F.lit("["), leaf, "]", depth)).otherwise(nested(F.lit('{"c":'), leaf, "}", depth))
    docs = spread(t(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", uri.alias("schema_uri"), F.parse_json(content).alias("instance"))
    return V.validate(docs, BRANCHES, ["p_partkey"]).select("p_partkey", "instance_path", "kind")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS r, o_orderkey % 8 AS f FROM orders)
SELECT o_orderkey, '/least' AS instance_path, 'minimum' AS kind FROM o WHERE r = 0
UNION ALL SELECT o_orderkey, '/less', 'exclusive_maximum' FROM o WHERE 100000000000000000000000000000::HUGEINT + o_orderkey >= 100000000000000000000000001000::HUGEINT
UNION ALL SELECT o_orderkey, '/tiny', 'multiple_of' FROM o WHERE r <> 0
UNION ALL SELECT o_orderkey, '/even', 'multiple_of' FROM o WHERE (100000000000000000000000000000::HUGEINT + o_orderkey) % 2 = 1
UNION ALL SELECT o_orderkey, '/cents', 'multiple_of' FROM o WHERE CAST(o_orderkey AS DECIMAL(20, 3)) / 1000 % 0.25 <> 0
UNION ALL SELECT o_orderkey, '/some', 'enum' FROM o WHERE f IN (3, 6)
UNION ALL SELECT o_orderkey, '/whole', 'type' FROM o WHERE f IN (4, 7)
""")
def numbers_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as their literals say them: beyond doubles, with exponents, of thirty digits, and remainders of small steps."""
    k = F.col("o_orderkey")
    forms = ["1e2", "100.00", "1E+2", "100.5", "25e-1", "2.50", "1e-12", "0.25e1"]
    whole = ["3", "3.0", "3e0", "30E-1", "3.5", "-0.0", "1e3", "1e-1"]
    pick = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % 8 + 1).cast("int"))
    digits = F.concat(F.lit("1"), F.lpad(text("o_orderkey"), 29, "0"))
    form = '{"least": <least>, "less": <digits>, "tiny": <k>e-12, "even": <digits>, "cents": <k>e-3, "some": <some>, "whole": <whole>}'
    content = filled(form, least=(F.lit(9007199254740992) + k % 3).cast("string"), digits=digits, k=text("o_orderkey"), some=pick(forms), whole=pick(whole))
    schema = json.loads(
        '{"properties": {"least": {"minimum": 9007199254740993}, "less": {"exclusiveMaximum": 100000000000000000000000001000}, "tiny": {"multipleOf": 3e-12}, "even": {"multipleOf": 2}, "cents": {"multipleOf": 0.25}, "some": {"enum": [100, 2.5]}, "whole": {"type": "integer"}}}'
    )
    docs = spread(t(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.parse_json(content).alias("instance"))
    return V.validate_one(docs, schema, ["o_orderkey"]).select("o_orderkey", "instance_path", "kind")


DRAFTS = {
    "d4": {"$schema": "http://json-schema.org/draft-04/schema#", "properties": {"n": {"minimum": 10, "exclusiveMinimum": True, "maximum": 40, "exclusiveMaximum": False, "const": 1}}},
    "d7": {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"n": {"type": "integer", "minimum": 10}}, "properties": {"n": {"$ref": "#/definitions/n", "maximum": 20}}, "dependentRequired": {"n": ["m"]}},
    "d9": {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {"n": {"type": "integer", "minimum": 10}}, "properties": {"n": {"$ref": "#/$defs/n", "maximum": 20}}, "dependentRequired": {"n": ["m"]}},
}


@query("""
WITH d AS (SELECT p_partkey, p_size, ['d4', 'd7', 'd9'][p_partkey % 3 + 1] AS u FROM part)
SELECT p_partkey, '/n' AS instance_path, 'exclusive_minimum' AS kind FROM d WHERE u = 'd4' AND p_size <= 10
UNION ALL SELECT p_partkey, '/n', 'maximum' FROM d WHERE (u = 'd4' AND p_size > 40) OR (u = 'd9' AND p_size > 20)
UNION ALL SELECT p_partkey, '/n', 'minimum' FROM d WHERE u <> 'd4' AND p_size < 10
UNION ALL SELECT p_partkey, '', 'required' FROM d WHERE u = 'd9'
""")
def schema_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas read as their drafts mean them: flags of draft 4, what stands beside a reference, keywords that came later."""
    uri = F.element_at(F.array(*[F.lit(u) for u in DRAFTS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    docs = t(spark, sf_dir, "part").select("p_partkey", uri.alias("schema_uri"), F.parse_json(F.concat(F.lit('{"n":'), text("p_size"), F.lit("}"))).alias("instance"))
    return V.validate(docs, DRAFTS, ["p_partkey"]).select("p_partkey", "instance_path", "kind")


#: As many schemas as a large repository has.
MANY = 550


@query(f"""
WITH d AS (SELECT o_orderkey, o_orderkey % {MANY} AS s, o_totalprice, length(o_orderpriority) AS n, o_orderstatus FROM orders)
SELECT o_orderkey, '/price' AS instance_path, 'maximum' AS kind FROM d WHERE s % 3 = 0 AND o_totalprice > 1000 * s
UNION ALL SELECT o_orderkey, '/priority', 'max_length' FROM d WHERE s % 3 = 1 AND n > 5 + s % 7
UNION ALL SELECT o_orderkey, '/status', 'enum' FROM d WHERE s % 3 = 2 AND o_orderstatus <> ['F', 'O', 'P'][s % 2 + 1]
""")
def orders_many_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """550 schemas of three shapes: the documents are scanned once and dealt by schema."""
    shapes = (lambda i: {"price": {"maximum": 1000 * i}}, lambda i: {"priority": {"maxLength": 5 + i % 7}}, lambda i: {"status": {"enum": ["FO"[i % 2]]}})
    schemas = {f"s{i}": {"properties": shapes[i % 3](i)} for i in range(MANY)}
    content = filled('{"price": <p>, "priority": "<w>", "status": "<s>"}', p=text("o_totalprice"), w=F.col("o_orderpriority"), s=F.col("o_orderstatus"))
    docs = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s"), (F.col("o_orderkey") % MANY).cast("string")).alias("schema_uri"), F.parse_json(content).alias("instance"))
    return V.validate(docs, schemas, ["o_orderkey"]).select("o_orderkey", "instance_path", "kind")


# -- indexes ----------------------------------------------------------------


@query("""
WITH p AS (SELECT page_id, 'site/' || page_id % 50 || '/a' || page_id || '.page.' || ['json', 'ts', 'md'][page_id % 3 + 1] AS path FROM pages)
SELECT page_id, count(*) AS n FROM (
SELECT page_id FROM p WHERE page_id % 50 < 40
UNION ALL SELECT page_id FROM p WHERE page_id % 3 = 0
UNION ALL SELECT page_id FROM p WHERE page_id % 50 BETWEEN 10 AND 19 AND page_id % 3 = 1
UNION ALL SELECT page_id FROM p WHERE contains(path, 'a7')
UNION ALL SELECT page_id FROM p WHERE regexp_matches(path, '/a[13][^/]*$')
) GROUP BY page_id
""")
def pages_pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs that are found by a prefix, a suffix, both, or a text inside; only one has no literal."""
    k = F.col("page_id")
    path = F.concat(F.lit("site/"), (k % 50).cast("string"), F.lit("/a"), text("page_id"), F.lit(".page."), F.element_at(F.array(F.lit("json"), F.lit("ts"), F.lit("md")), (k % 3 + 1).cast("int")))
    patterns = [f"site/{i}/**" for i in range(40)] + ["**/*.page.json"] + [f"site/{i}/*.ts" for i in range(10, 20)] + ["**/*a7*"] + ["**/a[13]*"]
    rows = pattern_rows(spark, list(enumerate(patterns)), ["ord", "pattern"])
    return R.all_matches_by_strategy(t(spark, sf_dir, "pages").select("page_id", path.alias("path")), rows).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT DISTINCT p_size % 5 AS k, substr(p_name, 2) AS property FROM part), d AS (SELECT p_size % 5 AS k, p_name AS known, min(p_partkey) AS ord FROM part GROUP BY ALL),
s AS (SELECT k, property, known, ord, levenshtein(lower(property), lower(known)) AS e, greatest(strlen(property), strlen(known)) AS m FROM u JOIN d USING (k))
SELECT u.k, u.property, (SELECT arg_min(known, (e, ord)) FROM s WHERE s.k = u.k AND s.property = u.property AND e <= 3 AND e * 2 <= m) AS suggestion FROM u
""")
def part_name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their first letter against all names of five groups: the nearest by an index of pieces."""
    rows = t(spark, sf_dir, "part")
    k = (F.col("p_size") % 5).alias("k")
    declared = rows.groupBy(k, F.col("p_name").alias("known")).agg(F.min("p_partkey").alias("ord"))
    return R.suggest(rows.select(k, F.expr("substr(p_name, 2)").alias("property")).distinct(), declared, ["k"]).select("k", "property", "suggestion")


@query("""
SELECT o_orderkey, 'sh' || o_orderkey % 7 AS key FROM orders UNION ALL SELECT o_orderkey, 'sh' || o_orderkey % 7 || '-' || o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
""")
def orders_prefix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("sh"), (F.col("o_orderkey") % 7).cast("string"), F.lit("-"), F.col("o_orderstatus"), F.lit("/"), "o_orderpriority").alias("text"))
    keys = spark.createDataFrame([(f"sh{i}{e}",) for i in range(7) for e in ("", "-F", "-O", "-FO/x")], "key string")
    return R.prefix_join(rows, keys, "text", "key").select("o_orderkey", "key")


@query("""SELECT page_id, page_id % 4 IN (1, 3) AS kept FROM pages""")
def pages_matching_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths match at least one of a set of globs."""
    path = F.concat(F.lit("d"), (F.col("page_id") % 4).cast("string"), F.lit("/x"), text("page_id"), F.lit(".html")).alias("path")
    rows = t(spark, sf_dir, "pages").select("page_id", path)
    hit = R.matching_any(rows, pattern_rows(spark, [(0, "d1/**"), (1, "d3/*.html"), (2, "d[13]/**"), (3, "d2/*.xml")], ["ord", "pattern"])).select("page_id", F.lit(True).alias("kept"))
    return rows.select("page_id").join(hit, "page_id", "left").select("page_id", F.coalesce("kept", F.lit(False)).alias("kept"))


# -- sources ----------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN strlen(event_type) + 10 WHEN 4 THEN strlen(event_type) + 9 WHEN 5 THEN 0 WHEN 6 THEN 10 + strlen(CAST(event_id AS VARCHAR)) ELSE NULL END AS off FROM events
""")
def events_syntax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte at which malformed JSON breaks: a colon, a value, a comma, an end, a bracket that is missing or too many."""
    k, kind = F.col("event_id"), F.col("event_type")
    forms = ['{"k": "<kind>", "n": [1, 2,], } // ok', '{"k" "<kind>"}', '{"k": <kind>}', '{"é": "<kind>" "n": 1}', '{"k": ["<kind>"}', "", '{"k": [<id>, ]]}', '/* "{ */ {"k": "<kind>"}']
    content = F.element_at(F.array(*[F.lit(f) for f in forms]), (k % 8 + 1).cast("int"))
    content = F.replace(F.replace(content, F.lit("<kind>"), kind), F.lit("<id>"), k.cast("string"))
    docs = S.normalize_documents(t(spark, sf_dir, "events").select("event_id", F.lit("a.json").alias("path"), content.alias("content")))
    return docs.select("event_id", F.col("parse_error.offset").cast("long").alias("off"))


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER w AS line, strlen(text) AS n, sum(CASE WHEN turn % 5 = 3 THEN 13 ELSE 11 + strlen(CAST(turn AS VARCHAR)) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'c/' || conv_id || '.jsonl' AS path, min(line) AS line, CAST(8 AS BIGINT) AS col, CAST(arg_min(coalesce(before, 0) + 9, line) AS BIGINT) AS off FROM r WHERE turn % 5 = 3 GROUP BY conv_id
""")
def conversations_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and byte of the token that rejects a file of JSON lines."""
    line = F.when(F.col("turn") % 5 == 3, F.lit('{"ö": 1 2 }')).otherwise(F.concat(F.lit('{"turn": '), text("turn"), F.lit("}")))
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    files = rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c/"), text("conv_id"), F.lit(".jsonl")).alias("path"), F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("content"))
    _, bad = S.jsonl_failures(S.explode_jsonl(files))
    return S.jsonl_syntax_errors(bad).select("path", F.col("line").cast("long"), (F.col("column") - 1).cast("long").alias("col"), F.col("offset").cast("long").alias("off"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_size % 3 AS s FROM part)
SELECT id, CASE s WHEN 0 THEN 'malformed JSON' WHEN 1 THEN NULL ELSE 'no list of schemas' END AS said, CASE WHEN s = 1 THEN 2 ELSE 0 END AS entries FROM p
""")
def catalogs_with_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of which some are broken: their entries are missing, and a warning says why."""
    forms = F.array(F.lit('{"schemas": [{"name": "a", '), F.lit('{"version": 1, "schemas": [{"name": "a", "url": "u/<k>", "fileMatch": ["*.a"]}, {"name": "b", "url": "v"}]}'), F.lit('{"version": 1, "schemas": "<k>"}'))
    content = F.replace(F.element_at(forms, (F.col("p_size") % 3 + 1).cast("int")), F.lit("<k>"), text("p_partkey"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("cat_ord"), F.concat(F.lit("c/"), text("p_partkey")).alias("path"), content.alias("content"))
    entries, warnings = C.parse_catalogs(rows)
    n = entries.groupBy("cat_ord").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "cat_ord", "left").join(warnings.select("cat_ord", "message"), "cat_ord", "left").select(F.col("cat_ord").alias("id"), F.expr("replace(message, 'catalog skipped: ', '')").alias("said"), F.coalesce("n", F.lit(0)).alias("entries"))


@query("""
WITH f AS (SELECT DISTINCT 'r/' || page_id % 10 || '/' || page_id % 100 AS folder, page_id % 10 AS a, page_id % 100 AS b FROM pages), m AS (
SELECT folder, '*.own' AS key, 'own-' || b AS value FROM f WHERE b % 2 = 0
UNION ALL SELECT folder, '*.x', CASE WHEN b % 2 = 0 THEN 'leaf-' || b ELSE 'mid-' || a END FROM f
UNION ALL SELECT folder, '*.top', 'top' FROM f WHERE a <> 3)
SELECT folder, key, value, CASE WHEN a = 3 THEN 1 ELSE 2 END + (b % 2 = 0)::INT AS excluded FROM m JOIN f USING (folder)
""")
def pages_nested_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of three levels of folders: even leaves have their own, one folder of the middle level is a root."""
    a, b = F.col("page_id") % 10, F.col("page_id") % 100
    pages = t(spark, sf_dir, "pages").select(F.concat(F.lit("r/"), a.cast("string"), F.lit("/"), b.cast("string")).alias("folder"), a.alias("a"), b.alias("b")).distinct()
    made = lambda df, dir_, root, name, cells: df.select(dir_.alias("dir"), root.alias("root"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).distinct().select("dir", "root", F.array(F.lit(name)).alias("exclude"), F.create_map(*[F.col(f"c{i}") for i in range(len(cells))]).alias("schemas"))
    leaf = made(pages.filter("b % 2 = 0"), F.col("folder"), F.lit(False), "leaf", [F.lit("*.own"), F.concat(F.lit("own-"), text("b")), F.lit("*.x"), F.concat(F.lit("leaf-"), text("b"))])
    middle = made(pages, F.concat(F.lit("r/"), text("a")), F.col("a") == 3, "mid", [F.lit("*.x"), F.concat(F.lit("mid-"), text("a"))])
    top = made(pages, F.lit("r"), F.lit(True), "top", [F.lit("*.x"), F.lit("far"), F.lit("*.top"), F.lit("top")])
    lists, rows = C.folded_settings(leaf.unionByName(middle).unionByName(top), pages)
    return rows.filter("setting = 'schemas'").join(lists, "folder").select("folder", "key", "value", F.size("exclude").alias("excluded"))


@query("""
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS f FROM orders)
SELECT o_orderkey, f || '-' || o_orderkey AS name, o_orderkey AS n, CASE f WHEN 'a' THEN true ELSE NULL END AS more FROM o
""")
def orders_json5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON5: plain keys, single quotes, comments, trailing commas."""
    forms = F.array(F.lit("{name: 'a-<k>', n: <k>, more: true,} // end"), F.lit("{'name': \"b-<k>\", /* n */ n: <k>}"), F.lit('{"name": "c-<k>", "n": <k>, }'))
    content = F.replace(F.element_at(forms, (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("<k>"), text("o_orderkey"))
    docs = S.normalize_documents(t(spark, sf_dir, "orders").select("o_orderkey", F.lit("x.json5").alias("path"), content.alias("content")))
    at = lambda p, kind: F.try_variant_get("instance", p, kind)
    return docs.select("o_orderkey", at("$.name", "string").alias("name"), at("$.n", "long").alias("n"), at("$.more", "boolean").alias("more"))


@query("""SELECT p_partkey, 'a\\*' || p_name || '\\[' || p_partkey || '\\]' AS pattern, true AS same, false AS other FROM part""")
def part_escaped_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text as a glob that matches that text alone."""
    raw = F.concat(F.lit("a*"), "p_name", F.lit("["), text("p_partkey"), F.lit("]"))
    rows = t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), escape_glob(raw).alias("pattern"))
    unescaped = F.regexp_replace("pattern", r"\\(.)", "$1")
    return rows.select("p_partkey", "pattern", (unescaped == F.col("raw")).alias("same"), (unescaped == F.replace(F.col("raw"), F.lit("*"), F.lit("b"))).alias("other"))


@query("""
SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN ['https://raw.githubusercontent.com/org/' || p_partkey || '/dev/catalog.json'] WHEN p_size % 3 = 1 THEN ['x/' || p_partkey || '.json'] ELSE [] END) AS url FROM part WHERE p_size % 3 < 2
""")
def part_registry_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry shorthands with a branch, and plain URLs."""
    k = text("p_partkey")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("github:org/"), k, F.lit("/dev"))).otherwise(F.concat(F.lit("x/"), k, F.lit(".json")))
    return t(spark, sf_dir, "part").filter("p_size % 3 < 2").select("p_partkey", F.explode(U.expand_registry(name)).alias("url"))


@query("""
WITH p AS (SELECT p_partkey, 'g' || p_size % 5 AS grp FROM part) SELECT grp, count(*) AS n, min(p_partkey) AS first FROM p WHERE p_partkey % 3 <> 0 GROUP BY grp
""")
def part_implicit_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema files in a group's folder that the group does not list."""
    files = t(spark, sf_dir, "part").select(F.concat(F.lit("g"), (F.col("p_size") % 5).cast("string")).alias("group"), F.concat(text("p_partkey"), F.lit(".json")).alias("key"), F.col("p_partkey").alias("path"))
    left = K.implicit_members(files, files.filter("path % 3 = 0"))
    return left.groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("""SELECT o_orderkey, 's' || o_orderkey % 10 AS stem, 'u/' || o_orderkey % 10 AS uri FROM orders WHERE o_orderkey % 10 < 6""")
def orders_schema_test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files with the schema that their folder names."""
    schemas = spark.createDataFrame([(f"s{i}", f"u/{i}") for i in range(6)], "stem string, uri string")
    files = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("tests/s"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/"), text("o_orderkey"), F.lit(".json")).alias("path"))
    return stats.schema_test_pairs(schemas, files).select("o_orderkey", "stem", "uri")


@query("""
SELECT CASE WHEN event_type = 'click' THEN 'skipped' WHEN event_type = 'error' THEN 'error' ELSE 'annotated' END AS outcome, count(*) AS n FROM events GROUP BY 1
""")
def events_annotation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts an annotation changes, leaves, or cannot place."""
    kind = F.col("event_type")
    named = F.when(kind == "click", F.lit("https://h/a.json"))
    content = F.when(kind == "error", F.lit(None).cast("string")).when(kind == "click", A.annotated(F.lit("jsonc"), F.lit('{"a": 1}'), named)).otherwise(F.lit('{"a": 1}'))
    rows = t(spark, sf_dir, "events").select("event_id", F.lit("jsonc").alias("format"), content.alias("content"), named.alias("inline_uri"), F.lit("https://h/a.json").alias("schema_uri"))
    return A.outcome_counts(A.annotate(rows)).select("outcome", "n")


@query("""
SELECT 'p/' || p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'schema_fetch' ELSE 'schema_compile' END AS code, CASE p_size % 4 WHEN 0 THEN 'no schema at lost' WHEN 1 THEN 'unresolved reference #/$defs/gone' ELSE '"a b" is not a "uri-reference"' END AS message FROM part WHERE p_size % 4 < 3
""")
def part_schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing schema, one with a reference to nowhere, one with a reference that is none; the fourth compiles."""
    schemas = {"gone": {"properties": {"a": {"$ref": "#/$defs/gone"}}}, "bad": {"$ref": "a b"}, "good": {"$ref": "#/$defs/x", "$defs": {"x": {"items": {"$ref": "#"}}}}}
    uri = F.element_at(F.array(*[F.lit(u) for u in ("lost", "gone", "bad", "good")]), (F.col("p_size") % 4 + 1).cast("int"))
    docs = t(spark, sf_dir, "part").select(F.concat(F.lit("p/"), text("p_partkey")).alias("path"), uri.alias("schema_uri"))
    return V.schema_findings(docs, schemas)


@query("""
SELECT CAST(p_partkey AS INTEGER) AS entry_ord, p_name AS name, 'u/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN '*.' || p_size ELSE '' END AS globs FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS p_partkey, p_name, p_size FROM part)
""")
def part_catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog that is written as a file and read again, its entries in order."""
    rows = numbered(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"], "n")
    entry = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("u/"), text("n")).alias("url"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("*."), text("p_size")))).alias("fileMatch"))
    whole = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]).alias("schemas")).select(F.lit(1).alias("version"), "schemas")
    path = shared_path(spark, "catalog")  # a catalog is one file
    whole.coalesce(1).write.json(path)
    found = C.read_catalog(spark, path)
    return found.select("entry_ord", "name", "url", F.array_join("file_match", ",").alias("globs"))


@query("""
SELECT 'https://parts.example/' || p_partkey || '.json' AS uri, unnest(CASE p_partkey % 4 WHEN 0 THEN ['a b', 'x~/y'] WHEN 1 THEN ['n'] WHEN 2 THEN ['own', 'via'] ELSE ['deep', 'leaf'] END) AS name FROM part
""")
def schema_definitions_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that stay: named with percent signs and tildes, by an anchor, by the schema's own address, through other definitions; two that only name each other go."""
    forms = [
        '{"properties":{"a":{"$ref":"#/$defs/a%20b"},"b":{"$ref":"#/$defs/x~0~1y"}},"$defs":{"a b":true,"x~/y":true,"lost":true}}',
        '{"items":{"$ref":"#here"},"$defs":{"n":{"$anchor":"here"},"m":{"$anchor":"there"}}}',
        '{"$id":"https://parts.example/<k>.json","not":{"$ref":"https://parts.example/<k>.json#/$defs/via"},"$defs":{"via":{"$ref":"#/$defs/own"},"own":true,"other":{"$ref":"https://elsewhere.example/x.json#/$defs/other"}}}',
        '{"allOf":[{"$ref":"#/$defs/deep"}],"$defs":{"deep":{"properties":{"z":{"$ref":"#/$defs/leaf/items"}}},"leaf":{"items":{}},"p":{"$ref":"#/$defs/q"},"q":{"$ref":"#/$defs/p"}}}',
    ]
    body = F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("<k>"), text("p_partkey"))
    store = t(spark, sf_dir, "part").select(F.concat(F.lit("https://parts.example/"), text("p_partkey"), F.lit(".json")).alias("uri"), body.alias("body"))
    kept = G.prune_definitions(G.schema_nodes(store))
    return kept.filter("parent = '/$defs'").select("uri", F.col("key").alias("name"))


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS k FROM part WHERE p_size % 10 = 0 UNION SELECT k // 2 FROM r WHERE k > 1) SELECT 'u/' || k AS uri FROM r WHERE k > 0
""")
def part_ref_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tenth of the schemas reaches, each of which refers to the one of half its number: every node once, in as many rounds as the tree is deep."""
    rows = t(spark, sf_dir, "part")
    at = lambda k: F.concat(F.lit("u/"), k.cast("string"))
    edges = rows.filter("p_partkey > 1").select(at(F.col("p_partkey")).alias("src_uri"), at(F.floor(F.col("p_partkey") / 2)).alias("base"))
    return G.ref_reach(edges, rows.filter("p_size % 10 = 0").select(at(F.col("p_partkey")).alias("uri")))
