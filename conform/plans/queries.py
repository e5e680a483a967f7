"""The registered queries over the tables of a folder, and the same in DuckDB's SQL.

The tables hold no configuration files, so documents are made of rows: any table's rows as JSON objects, ``events.props`` as JSON texts,
``pages.url`` as paths, ``conversations`` as line-wise files. Rule and pattern tables are part of the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.functions import text as T
from conform.functions import urls as U
from conform.operators import diagnostics as D
from conform.operators import resolve as R
from conform.operators import validate as V
from conform.plans.stored import spread
from conform.sources import catalogs as C
from conform.sources import documents as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- rules over typed tables ------------------------------------------------

ORDER_SCHEMA = {
    "type": "object",
    "required": ["o_orderkey", "o_orderstatus", "o_clerk"],
    "properties": {
        "o_orderkey": {"type": "integer"},
        "o_orderstatus": {"enum": ["F", "O"]},
        "o_totalprice": {"type": "number", "minimum": 5000, "maximum": 450000},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-"},
    },
}


@query("""
SELECT '/o_orderstatus' AS instance_path, 'enum' AS kind, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0
UNION ALL SELECT '/o_totalprice', 'minimum', count(*) FROM orders WHERE o_totalprice < 5000 HAVING count(*) > 0
UNION ALL SELECT '/o_totalprice', 'maximum', count(*) FROM orders WHERE o_totalprice > 450000 HAVING count(*) > 0
UNION ALL SELECT '/o_orderpriority', 'pattern', count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-') HAVING count(*) > 0
UNION ALL SELECT '', 'required', count(*) FROM orders HAVING count(*) > 0
""")
def orders_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.validate_table(t(spark, sf_dir, "orders"), ORDER_SCHEMA, ["o_orderkey"])
    return D.counts_by(found, "instance_path", "kind")


LINE_SCHEMA = {
    "properties": {
        "l_quantity": {"exclusiveMinimum": 1, "exclusiveMaximum": 50, "multipleOf": 3},
        "l_extendedprice": {"minimum": 1000, "maximum": 90000},
        "l_discount": {"maximum": 0.08, "multipleOf": 0.02},
        "l_tax": {"exclusiveMinimum": 0},
    }
}


@query("""
SELECT l_orderkey, l_linenumber, instance_path, kind FROM (
SELECT l_orderkey, l_linenumber, '/l_quantity' AS instance_path, 'exclusive_minimum' AS kind FROM lineitem WHERE l_quantity <= 1
UNION ALL SELECT l_orderkey, l_linenumber, '/l_quantity', 'exclusive_maximum' FROM lineitem WHERE l_quantity >= 50
UNION ALL SELECT l_orderkey, l_linenumber, '/l_quantity', 'multiple_of' FROM lineitem WHERE l_quantity::DECIMAL(18,4) % 3 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, '/l_extendedprice', 'minimum' FROM lineitem WHERE l_extendedprice < 1000
UNION ALL SELECT l_orderkey, l_linenumber, '/l_extendedprice', 'maximum' FROM lineitem WHERE l_extendedprice > 90000
UNION ALL SELECT l_orderkey, l_linenumber, '/l_discount', 'maximum' FROM lineitem WHERE l_discount > 0.08
UNION ALL SELECT l_orderkey, l_linenumber, '/l_discount', 'multiple_of' FROM lineitem WHERE l_discount::DECIMAL(18,4) % 0.02 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, '/l_tax', 'exclusive_minimum' FROM lineitem WHERE l_tax <= 0)
""")
def lineitem_numeric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    found = V.validate_table(rows, LINE_SCHEMA, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.select("l_orderkey", "l_linenumber", "instance_path", "kind")


CUSTOMER_SCHEMA = {"properties": {"c_name": {"minLength": 18, "maxLength": 18, "pattern": "[02468]$"}, "c_mktsegment": {"minLength": 9, "maxLength": 9}}}


@query("""
SELECT c_custkey, '/c_name' AS instance_path, 'pattern' AS kind, 'value does not match "[02468]$"' AS message FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')
UNION ALL SELECT c_custkey, '/c_name', 'min_length', 'string is shorter than 18 characters' FROM customer WHERE length(c_name) < 18
UNION ALL SELECT c_custkey, '/c_name', 'max_length', 'string is longer than 18 characters' FROM customer WHERE length(c_name) > 18
UNION ALL SELECT c_custkey, '/c_mktsegment', 'min_length', 'string is shorter than 9 characters' FROM customer WHERE length(c_mktsegment) < 9
UNION ALL SELECT c_custkey, '/c_mktsegment', 'max_length', 'string is longer than 9 characters' FROM customer WHERE length(c_mktsegment) > 9
""")
def customer_length_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_table(t(spark, sf_dir, "customer"), CUSTOMER_SCHEMA, ["c_custkey"]).select("c_custkey", "instance_path", "kind", "message")


PROPS_SCHEMA = {"type": "object", "required": ["k", "source"], "properties": {"k": {"type": "string"}}, "maxProperties": 0, "additionalProperties": False}


@query("""
WITH d AS (SELECT event_id, props::JSON AS j FROM events WHERE json_valid(props)),
k AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM d)
SELECT event_id, '/k' AS instance_path, 'type' AS kind FROM d WHERE json_type(j, '$.k') <> 'VARCHAR'
UNION ALL SELECT event_id, '', 'required' FROM d WHERE NOT json_exists(j, '$.k')
UNION ALL SELECT event_id, '', 'required' FROM d WHERE NOT json_exists(j, '$.source')
UNION ALL SELECT event_id, '', 'max_properties' FROM d WHERE len(json_keys(j)) > 0
UNION ALL SELECT event_id, '/' || key, 'additional_property' FROM k WHERE key <> 'k'
""")
def events_props_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "events").select("event_id", S.parse_jsonc(F.col("props")).alias("instance"))
    return V.validate_one(docs.filter("instance IS NOT NULL"), PROPS_SCHEMA, ["event_id"]).select("event_id", "instance_path", "kind")


FORMAT_SCHEMA = {"properties": {"ts": {"format": "date-time"}, "day": {"format": "date"}, "mail": {"format": "email"}, "ip": {"format": "ipv4"}}}


@query("""
SELECT event_id, '/day' AS instance_path FROM events WHERE user_id % 20 > 12 OR user_id % 20 < 1
UNION ALL SELECT event_id, '/mail' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, '/ip' FROM events WHERE event_id % 300 > 255
""")
def events_format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(
        "event_id", "ts", F.format_string("2024-%02d-10", (F.col("user_id") % 20).cast("int")).alias("day"),
        F.concat("event_type", F.when(F.col("event_type") == "click", F.lit(" at ")).otherwise(F.lit("@")), F.lit("example.com")).alias("mail"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 300).cast("string")).alias("ip"),
    )
    return V.validate_table(rows, FORMAT_SCHEMA, ["event_id"], ["ts", "day", "mail", "ip"]).select("event_id", "instance_path")


COMBINED_SCHEMA = {
    "oneOf": [{"properties": {"value": {"minimum": 50}}}, {"properties": {"value": {"maximum": 100}}}],
    "anyOf": [{"properties": {"event_type": {"const": "click"}}}, {"properties": {"value": {"minimum": 10}}}],
    "not": {"properties": {"event_type": {"const": "error"}}},
    "if": {"properties": {"event_type": {"const": "purchase"}}},
    "then": {"properties": {"value": {"minimum": 20}}},
    "else": {"properties": {"value": {"maximum": 300}}},
}


@query("""
SELECT kind, count(*) AS n FROM (
SELECT 'one_of_multiple_valid' AS kind FROM events WHERE value >= 50 AND value <= 100
UNION ALL SELECT 'one_of_not_valid' FROM events WHERE value < 50 AND value > 100
UNION ALL SELECT 'any_of' FROM events WHERE event_type <> 'click' AND value < 10
UNION ALL SELECT 'not' FROM events WHERE event_type = 'error'
UNION ALL SELECT 'minimum' FROM events WHERE event_type = 'purchase' AND value < 20
UNION ALL SELECT 'maximum' FROM events WHERE event_type <> 'purchase' AND value > 300) GROUP BY kind
""")
def events_oneof_anyof_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counts_by(V.validate_table(t(spark, sf_dir, "events"), COMBINED_SCHEMA, ["event_id"], ["event_type", "value"]), "kind")


ARRAY_SCHEMA = {"properties": {"lines": {"minItems": 3, "maxItems": 6, "uniqueItems": True, "contains": {"minimum": 45}, "maxContains": 1, "items": {"maximum": 49}}}}


@query("""
WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
x AS (SELECT l_orderkey, unnest(range(0, len(q))) AS i, unnest(q) AS v FROM a)
SELECT l_orderkey, '/lines' AS instance_path, 'min_items' AS kind FROM a WHERE len(q) < 3
UNION ALL SELECT l_orderkey, '/lines', 'max_items' FROM a WHERE len(q) > 6
UNION ALL SELECT l_orderkey, '/lines', 'unique_items' FROM a WHERE len(list_distinct(q)) < len(q)
UNION ALL SELECT l_orderkey, '/lines', 'contains' FROM x GROUP BY l_orderkey HAVING count(*) FILTER (v >= 45) NOT BETWEEN 1 AND 1
UNION ALL SELECT l_orderkey, '/lines/' || i, 'maximum' FROM x WHERE v > 49
""")
def order_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", "l_partkey", "l_quantity")
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l_quantity"]).alias("lines"))
    return V.validate_table(rows, ARRAY_SCHEMA, ["l_orderkey"], ["lines"]).select("l_orderkey", "instance_path", "kind")


# -- paths, globs and resolution --------------------------------------------

_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without scheme, query and fragment as paths."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), path.alias("path"), "url")


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id AS doc_id, regexp_matches(path, '^[^/]*\\.example\\.(com|org)/en/[^/]*$') AS english, regexp_matches(path, '^(.*/)?[^/]*\\.html$') AS html,
  regexp_extract(path, '^([^/]*)\\.example\\.([^/]*)/(.*)$', 1) AS host, regexp_extract(path, '^([^/]*)\\.example\\.([^/]*)/(.*)$', 3) AS rest FROM p
""")
def pages_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.functions.globs import glob_captures, glob_match

    caught = glob_captures(F.col("path"), "*.example.*/**")
    return page_paths(spark, sf_dir).select("doc_id", glob_match(F.col("path"), "*.example.{com,org}/en/*").alias("english"), glob_match(F.col("path"), "**/*.html").alias("html"), caught[0].alias("host"), caught[2].alias("rest"))


CATALOG = [
    (0, "spam", "https://schemas.example/spam.json", ["*cheap-pills*/**", "spam-farm.example.*/**"]),
    (1, "html", "https://schemas.example/html.json", ["*.html", "!*.htm"]),
    (2, "english", "https://schemas.example/en.json", ["*.example.com/en/*", "*.example.org/en/*"]),
    (3, "german", "https://schemas.example/de.json", ["*/de/**"]),
    (4, "blog", "https://schemas.example/blog.json", ["blog.*/**", "m.*/{en,fr}/[0-9]*"]),
]
_CATALOG_SQL = f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
pats(entry_ord, pat_ord, url, name, re) AS (VALUES
 (0, 0, 'https://schemas.example/spam.json', 'spam', '^[^/]*cheap-pills[^/]*/.*$'), (0, 1, 'https://schemas.example/spam.json', 'spam', '^spam-farm\\.example\\.[^/]*/.*$'),
 (1, 0, 'https://schemas.example/html.json', 'html', '^(.*/)?[^/]*\\.html$'),
 (2, 0, 'https://schemas.example/en.json', 'english', '^[^/]*\\.example\\.com/en/[^/]*$'), (2, 1, 'https://schemas.example/en.json', 'english', '^[^/]*\\.example\\.org/en/[^/]*$'),
 (3, 0, 'https://schemas.example/de.json', 'german', '^[^/]*/de/.*$'),
 (4, 0, 'https://schemas.example/blog.json', 'blog', '^blog\\.[^/]*/.*$'), (4, 1, 'https://schemas.example/blog.json', 'blog', '^m\\.[^/]*/(en|fr)/[0-9][^/]*$')),
m AS (SELECT page_id, entry_ord, pat_ord, pats.url, name, row_number() OVER (PARTITION BY page_id ORDER BY entry_ord, pat_ord) AS rn FROM p JOIN pats ON regexp_matches(path, re))
"""
_FIRST_SQL = _CATALOG_SQL + "SELECT page_id AS doc_id, entry_ord, pat_ord, url, name FROM m WHERE rn = 1"


def _first_match(spark: SparkSession, sf_dir: str, by_strategy: bool) -> DataFrame:
    found = R.resolve_catalog(page_paths(spark, sf_dir), C.catalog_patterns(spark, CATALOG), by_strategy=by_strategy)
    return found.select("doc_id", "match.entry_ord", "match.pat_ord", "match.url", "match.name")


@query(_FIRST_SQL)
def pages_catalog_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_match(spark, sf_dir, False)


@query(_FIRST_SQL)
def pages_strategy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_match(spark, sf_dir, True)


@query(_CATALOG_SQL.replace("pats(entry", "maps(ord, re, uri) AS (VALUES (0, '^(.*/)?[^/]*\\.html$', '//local/html.json'), (1, '^[^/]*/es/[^/]*$', 'https://schemas.example/es.json')),\npats(entry") + """,
u AS (SELECT page_id, arg_min(uri, ord) AS uri FROM p JOIN maps ON regexp_matches(path, re) GROUP BY page_id),
i AS (SELECT page_id, CASE WHEN url LIKE '%#top' THEN 'https://inline.example/top.json' END AS uri, path FROM pages JOIN p USING (page_id))
SELECT i.page_id AS doc_id, coalesce(i.uri, u.uri, m.url) AS schema_uri,
 CASE WHEN i.uri IS NOT NULL THEN 'inline' WHEN u.uri IS NOT NULL THEN 'mapping' WHEN m.url IS NOT NULL THEN 'catalog' END AS source,
 CASE WHEN i.uri IS NULL AND u.uri IS NULL THEN m.name END AS name
FROM i LEFT JOIN u USING (page_id) LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (page_id)
""")
def pages_resolution_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = C.Config(schemas={"*.html": "//local/html.json", "*/es/*": "https://schemas.example/es.json"})
    docs = page_paths(spark, sf_dir)
    inline = F.when(F.col("url").endswith("#top"), F.lit("https://inline.example/top.json"))
    return R.identify(docs, inline, config.mapping_table(spark), C.catalog_patterns(spark, CATALOG)).select("doc_id", "schema_uri", "source", "name")


@query("""
WITH r(f, t) AS (VALUES ('http://', 'https://'), ('https://www.', 'https://'), ('https://blog.', 'file:///blog/'), ('https://blog.th', 'file:///th/')),
b AS (SELECT url, arg_max(f, length(f)) AS f, arg_max(t, length(f)) AS t FROM pages JOIN r ON starts_with(url, f) GROUP BY url)
SELECT page_id AS doc_id, CASE WHEN f IS NULL THEN p.url ELSE t || substr(p.url, length(f) + 1) END AS schema_uri FROM pages p LEFT JOIN b ON b.url = p.url
""")
def pages_uri_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = C.Config(rewrite={"http://": "https://", "https://www.": "https://", "https://blog.": "file:///blog/", "https://blog.th": "file:///th/"}).rewrite_table(spark)
    return R.apply_rewrites(t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("schema_uri")), rules).select("doc_id", "schema_uri")


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
o AS (SELECT page_id, split_part(path, '/', 2) AS schema_uri, CASE WHEN regexp_matches(path, '^(.*/)?[^/]*\\.html$') AND split_part(path, '/', 2) = 'es' THEN false WHEN regexp_matches(path, '^blog\\.[^/]*/.*$') THEN true WHEN split_part(path, '/', 2) = 'de' THEN false ELSE true END AS validate_formats FROM p)
SELECT page_id AS doc_id, schema_uri, validate_formats, bool_and(validate_formats) OVER (PARTITION BY schema_uri) AS group_formats FROM o
""")
def pages_override_group_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = page_paths(spark, sf_dir).withColumn("schema_uri", F.split_part("path", F.lit("/"), F.lit(2))).withColumn("original_uri", F.col("schema_uri"))
    rules = [(0, ["*/es/*.html"], [], False), (1, ["blog.*/**"], [], True), (2, [], ["de"], False), (3, ["**"], [], None)]
    return R.group_format_checks(R.format_checks(docs, rules)).select("doc_id", "schema_uri", "validate_formats", "group_formats")


@query("""
WITH a AS (SELECT page_id, url, split_part(url, '#', 1) AS base, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) END AS fragment, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
b AS (SELECT *, split_part(path, '/', -1) AS last FROM a)
SELECT page_id AS doc_id, base, fragment, path, CASE WHEN last = '' THEN host || '.json' WHEN lower(last) LIKE '%.json' THEN last ELSE last || '.json' END AS filename,
 regexp_extract(url, '^[a-z]+://', 0) || host || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'defs.json#/x' AS joined FROM b
""")
def pages_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), U.base_of(url).alias("base"), U.fragment_of(url).alias("fragment"), U.url_path(url).alias("path"), U.filename_of(url).alias("filename"), U.url_join(url, F.lit("../defs.json#/x")).alias("joined"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id AS doc_id, path FROM p WHERE NOT regexp_matches(path, '^(.*/)?[^/]*\\.html$') AND NOT regexp_matches(path, '^(www|m)\\.[^/]*/.*$')
""")
def pages_exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).filter(~S.excluded(F.col("path"), ["**/*.html", "{www,m}.*/**"])).select("doc_id", "path")


# -- names and texts --------------------------------------------------------

KNOWN_NAMES = ["small rings", "red wigdet", "bluebolt", "hot gears", "tiny gizmo", "Big Gear"]


@query(f"""
WITH k(ord, known) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(KNOWN_NAMES))}), n AS (SELECT DISTINCT p_name FROM part),
d AS (SELECT p_name, known, ord, levenshtein(lower(p_name), lower(known)) AS d FROM n, k),
b AS (SELECT p_name, arg_min(known, (d, ord)) AS suggestion FROM d WHERE d <= 3 AND d * 2 <= greatest(strlen(p_name), strlen(known)) GROUP BY p_name)
SELECT n.p_name AS property, suggestion FROM n LEFT JOIN b USING (p_name)
""")
def part_did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "part").select(F.lit("part").alias("schema_uri"), F.col("p_name").alias("property")).distinct()
    known = spark.createDataFrame([("part", i, x) for i, x in enumerate(KNOWN_NAMES)], "schema_uri string, ord int, known string")
    return R.suggest(names, known, ["schema_uri"]).select("property", "suggestion")


@query("""
WITH s AS (SELECT p_partkey, p_brand AS dir, trim(lower(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY dir, slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, dir, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM r
""")
def part_slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.catalog import unique_slugs

    rows = t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("dir"), T.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))
    return unique_slugs(rows, "dir", "slug", "p_partkey")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line-wise file for each conversation, a line for each turn with its whole text, each naming a schema by its role. A conversation is a document, so its turns meet in one row."""
    said = F.coalesce(F.regexp_replace(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', "$1"), F.lit("null"))
    said = F.when(F.col("text").isNull(), F.lit("null")).otherwise(said)
    line = F.concat(F.lit('{"$schema": "'), F.coalesce("role", F.lit("")), F.lit('.json", "turn": '), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit(', "text": '), said, F.lit("}"), F.when(F.col("turn") % 3 == 2, F.lit("\r\n")).otherwise(F.lit("")))
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("content"))


_LINES = """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, '{"$schema": "' || coalesce(role, '') || '.json", "turn": ' || coalesce(turn::VARCHAR, 'null') || ', "text": ' || coalesce(to_json(text)::VARCHAR, 'null') || '}' AS raw, turn % 3 = 2 AS extra FROM conversations),
s AS (SELECT *, 1 + coalesce(sum(CASE WHEN extra THEN 2 ELSE 1 END) OVER w, 0) AS line, coalesce(sum(strlen(raw) + CASE WHEN extra THEN 3 ELSE 1 END) OVER w, 0) AS byte_offset FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(_LINES + "SELECT conv_id AS doc_id, CAST(line AS BIGINT) AS line, CAST(byte_offset AS BIGINT) AS byte_offset, raw FROM s")
def conversations_jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explode_jsonl(conversation_files(spark, sf_dir)).select("doc_id", F.col("line").cast("long").alias("line"), F.col("byte_offset").cast("long").alias("byte_offset"), "raw")


@query(_LINES + """, f AS (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY i) AS f FROM s)
SELECT 'c/' || conv_id || '.jsonl' AS path, CAST(line AS BIGINT) AS line, f || '.json' AS expected, role || '.json' AS found FROM f WHERE role <> f""")
def conversations_schema_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.jsonl_schema_mismatches(S.explode_jsonl(conversation_files(spark, sf_dir)))
    return found.select("path", F.col("line").cast("long").alias("line"), "expected", "found")


@query("""
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1
""")
def documents_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"))


@query("""
WITH k AS (SELECT doc_id, source, sha256('1' || text || source || chr(1)) AS cache_key FROM documents), old AS (SELECT DISTINCT cache_key FROM k WHERE source IN ('src0', 'src1'))
SELECT CASE WHEN o.cache_key IS NULL THEN 'miss' ELSE 'hit' END AS status, count(*) AS n, count(DISTINCT k.cache_key) AS distinct_keys FROM k LEFT JOIN old o USING (cache_key) GROUP BY 1
""")
def documents_incremental_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.incremental import cache_key, split_by_cache

    rows = t(spark, sf_dir, "documents").select("doc_id", "source", cache_key(F.col("text"), F.col("source"), F.lit(True)).alias("cache_key"))
    old = rows.filter(F.col("source").isin("src0", "src1")).select("cache_key").distinct()
    hits, misses = split_by_cache(rows, old)
    both = hits.select("cache_key", F.lit("hit").alias("status")).unionByName(misses.select("cache_key", F.lit("miss").alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cache_key").alias("distinct_keys"))


@query("""
SELECT doc_id, md5(regexp_replace(text || ' see https://a.example/x, (http://b.example) <http://c.example> http://d.example/y.;', '(^|[^<(])(https?://(?:[^\\s>"''`]*[^\\s>"''`.,;])?)', '\\1<\\2>', 'g')) AS linked FROM documents
""")
def documents_linkify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(T.linkify(F.concat("text", F.lit(" see https://a.example/x, (http://b.example) <http://c.example> http://d.example/y.;")))).alias("linked"))


@query("""
SELECT doc_id, CAST(1 + length(substr(text, 1, n)) - length(replace(substr(text, 1, n), chr(10), '')) AS BIGINT) AS line,
 CAST(1 + length(split_part(substr(text, 1, n), chr(10), -1)) AS BIGINT) AS col
FROM (SELECT doc_id, text, CAST(length(text) // 2 AS BIGINT) AS n FROM documents)
""")
def documents_line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").withColumn("half", F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))))
    at = T.line_col(F.col("text"), F.col("half"))
    return rows.select("doc_id", at["line"].cast("long").alias("line"), at["col"].cast("long").alias("col"))


# -- graphs -----------------------------------------------------------------


def nation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that refer to each other: a chain by threes within a region, and one that leads nowhere."""
    n = t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("k2"), F.col("n_regionkey").alias("r2"))
    near = a.join(b, (F.col("r") == F.col("r2")) & ((F.col("k2") - F.col("k")).isin(5, -15)))
    edges = near.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("src_uri"), F.concat(F.lit("n"), F.col("k2").cast("string")).alias("base"))
    lost = a.filter("k % 7 = 3").select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("src_uri"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("base"))
    return edges.unionByName(lost)


_REFS = """
WITH RECURSIVE e AS (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (b.n_nationkey - a.n_nationkey) IN (5, -15)
UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey FROM nation WHERE n_nationkey % 7 = 3)"""


@query(_REFS + """, c(root, uri) AS (SELECT src, dst FROM e UNION SELECT c.root, e.dst FROM c JOIN e ON e.src = c.uri)
SELECT root, uri FROM c""")
def nation_ref_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.schemagraph import ref_closure

    return ref_closure(nation_refs(spark, sf_dir)).select("root", "uri")


@query(_REFS + "SELECT src AS src_uri, dst AS base FROM e WHERE dst NOT IN (SELECT 'n' || n_nationkey FROM nation)")
def nation_dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("base"))
    return nation_refs(spark, sf_dir).join(known, "base", "left_anti").select("src_uri", "base")


PREFIXES = ["Supplier#", "Supplier#00000000", "Supplier#00000001", "Supplier#000000042", "Customer#"]


@query(f"""
SELECT s_suppkey, key FROM supplier JOIN (VALUES {', '.join(f"('{x}')" for x in PREFIXES)}) k(key) ON starts_with(s_name, key)
""")
def supplier_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(x,) for x in PREFIXES], "key string")
    return R.prefix_join(t(spark, sf_dir, "supplier"), keys, "s_name", "key").select("s_suppkey", "key")


# -- diagnostics ------------------------------------------------------------


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.validate_table(t(spark, sf_dir, "orders"), {"properties": ORDER_SCHEMA["properties"]}, ["o_orderkey"]).withColumn("path", F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")))
    events = t(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("path"), F.lit("malformed JSON").alias("message"), F.col("event_id").cast("int").alias("offset"))
    return D.diagnostics([("validation", orders), ("parse", events)])


_FINDINGS = """
WITH f AS (
SELECT 'orders/' || o_orderkey AS path, 'validation' AS code, 'value is not one of: "F", "O"' AS message, 0 AS off, '/o_orderstatus' AS ip FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'orders/' || o_orderkey, 'validation', 'value is less than the minimum of 5000', 0, '/o_totalprice' FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT 'orders/' || o_orderkey, 'validation', 'value is greater than the maximum of 450000', 0, '/o_totalprice' FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT 'orders/' || o_orderkey, 'validation', 'value does not match "^[1-4]-"', 0, '/o_orderpriority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
UNION ALL SELECT 'events/' || event_id, 'parse', 'malformed JSON', event_id, '' FROM events WHERE event_type = 'error')
"""


@query(_FINDINGS + """
SELECT CAST((row_number() OVER (ORDER BY path, off, code, message, ip) - 1) // 50 AS BIGINT) AS batch, path, message, CASE WHEN code = 'parse' THEN 'parse error' ELSE ip END AS title FROM f
""")
def diagnostics_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.annotations(_all_findings(spark, sf_dir)).select("batch", "path", "message", "title")


@query(_FINDINGS + """
SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS files_checked, (SELECT count(*) FROM f) AS errors_found, (SELECT count(*) > 0 FROM f) AS had_errors
""")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = t(spark, sf_dir, "orders").select(F.lit(1)).unionAll(t(spark, sf_dir, "events").select(F.lit(1)))
    return D.summary(checked, _all_findings(spark, sf_dir))


@query(_FINDINGS + """
SELECT code, message, count(*) AS n FROM f GROUP BY ROLLUP (code, message)
""")
def diagnostics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counts_by(_all_findings(spark, sf_dir), "code", "message", subtotals=True)


@query("""
SELECT l_returnflag, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, list(l_quantity ORDER BY l_quantity)[count(*) // 2 + 1] AS median, count(*) AS runs FROM lineitem GROUP BY l_returnflag
""")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.stats import timing_stats

    return timing_stats(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


# -- whole documents through the pipeline -----------------------------------


@query("""
WITH j AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'toml' ELSE 'md' END AS ext, o_totalprice, o_orderpriority FROM orders)
SELECT o_orderkey AS doc_id, ext, '/price' AS instance_path, 'maximum' AS kind FROM j WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, ext, '', 'required' FROM j WHERE o_orderpriority = '5-LOW'
""")
def orders_formats_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, prio = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    ext = F.element_at(F.array(F.lit("json"), F.lit("yaml"), F.lit("toml"), F.lit("md")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    yaml = F.concat(F.lit("price: "), price, F.coalesce(F.concat(F.lit("\npriority: '"), prio, F.lit("'")), F.lit("")), F.lit("\n"))
    content = (
        F.when(ext == "json", F.concat(F.lit('{ // an order\n "price": '), price, F.coalesce(F.concat(F.lit(', "priority": "'), prio, F.lit('"')), F.lit("")), F.lit(",}")))
        .when(ext == "toml", F.concat(F.lit("price = "), price, F.coalesce(F.concat(F.lit('\npriority = "'), prio, F.lit('"')), F.lit(""))))
        .when(ext == "yaml", yaml)
        .otherwise(F.concat(F.lit("<!-- note -->\n---\n"), yaml, F.lit("---\n# Order\n")))
    )
    orders = spread(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), ext.alias("ext"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit("."), ext).alias("path"), content.alias("content"))
    docs = S.normalize_documents(rows).filter(F.col("parse_error").isNull())
    schema = {"type": "object", "properties": {"price": {"type": "number", "maximum": 400000}, "priority": {"type": "string"}}, "required": ["price", "priority"], "additionalProperties": False}
    return V.validate_one(docs, schema, ["doc_id", "ext"]).select("doc_id", "ext", "instance_path", "kind")


@query("""
WITH d AS (SELECT event_id, event_type, value, props::JSON AS j FROM events)
SELECT event_id AS doc_id, '' AS pointer, 'OBJECT' AS jtype, 0 AS depth FROM d UNION ALL SELECT event_id, '/k', 'BIGINT', 1 FROM d
UNION ALL SELECT event_id, '/tags', 'ARRAY', 1 FROM d UNION ALL SELECT event_id, '/tags/0', 'STRING', 2 FROM d UNION ALL SELECT event_id, '/tags/1', 'DECIMAL', 2 FROM d
""")
def events_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "tags": ["'), "event_type", F.lit('", 1.5]}'))
    docs = t(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), S.parse_jsonc(content).alias("instance"))
    return S.explode_nodes(docs, deepest=4).select("doc_id", "pointer", "jtype", "depth")


@query()
def unevaluated_and_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {
        "$defs": {"who": {"properties": {"user_id": {"type": "integer"}}, "required": ["user_id"]}},
        "allOf": [{"$ref": "#/$defs/who"}],
        "if": {"properties": {"event_type": {"const": "click"}}},
        "then": {"properties": {"value": {"type": "number"}, "event_type": True}},
        "unevaluatedProperties": False,
    }
    rows = t(spark, sf_dir, "events").select("event_id", F.to_variant_object(F.struct("user_id", "event_type", "value")).alias("instance"))
    return V.validate_one(rows, schema, ["event_id"]).select("event_id", "instance_path", "kind", "message")


ORACLES["unevaluated_and_refs"] = """
SELECT event_id, '' AS instance_path, 'unevaluated_properties' AS kind, 'Unevaluated properties are not allowed (''event_type'', ''value'' were unexpected)' AS message FROM events WHERE event_type <> 'click'
"""


# -- schemas made of rows ---------------------------------------------------


def part_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft-04 schema of every part: ``uri, body``."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(
        F.lit('{"$schema":"http://json-schema.org/draft-04/schema#","id":"https://parts.example/'), k, F.lit('.json","title":"'), F.col("p_name"),
        F.lit('","definitions":{"size":{"type":"integer","minimum":'), size, F.lit(',"exclusiveMinimum":true},"spare":{"type":"null"}},"properties":{"brand":{"type":"string","required":true,"enum":["'), F.col("p_brand"),
        F.lit('","'), F.col("p_brand"), F.lit('","any"],"description":"Brand of '), F.col("p_name"), F.lit('"},"size":{"$ref":"#/definitions/size"},"tags":{"type":"array","items":[{"type":"string","maxLength":'), size,
        F.lit('}],"additionalItems":false},"next":{"$ref":"https://parts.example/'), (F.col("p_partkey") + 7).cast("string"),
        F.lit('.json#/definitions/size"}},"dependencies":{"brand":["size"],"size":{"required":["tags"]}}}'),
    )
    return t(spark, sf_dir, "part").select(F.concat(F.lit("https://parts.example/"), k, F.lit(".json")).alias("uri"), body.alias("body"))


@query("""
SELECT 'https://parts.example/' || p_partkey || '.json' AS uri, 'https://json-schema.org/draft/2020-12/schema' AS draft, 'https://parts.example/' || p_partkey || '.json' AS id, CAST(p_size AS BIGINT) AS low,
 '["brand"]' AS required, '["' || p_brand || '","any"]' AS brands, '#/$defs/size' AS size_ref, '[{"maxLength":' || p_size || ',"type":"string"}]' AS prefix, 'false' AS items, '["size"]' AS needs, '{"required":["tags"]}' AS needs_schema, 'object' AS type, false AS old_keys FROM part
""")
def part_schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.schemagraph import migrate_schemas

    v = F.parse_json("body")
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    text = lambda path: F.to_json(F.try_variant_get(v, path, "variant"))
    return migrate_schemas(part_schemas(spark, sf_dir)).select(
        "uri", at('$["$schema"]').alias("draft"), at('$["$id"]').alias("id"), at('$["$defs"]["size"]["exclusiveMinimum"]', "long").alias("low"), text("$.required").alias("required"), text("$.properties.brand.enum").alias("brands"),
        at('$.properties.size["$ref"]').alias("size_ref"), text("$.properties.tags.prefixItems").alias("prefix"), text("$.properties.tags.items").alias("items"), text("$.dependentRequired.brand").alias("needs"), text("$.dependentSchemas.size").alias("needs_schema"), at("$.type").alias("type"),
        F.col("body").rlike('"(id|definitions|dependencies|additionalItems|minimum)":').alias("old_keys"),
    )


@query("""
WITH p AS (SELECT 'https://parts.example/' || p_partkey || '.json' AS uri, * FROM part)
SELECT uri, '' AS owner, 'brand' AS name, 'string' AS label, 'Brand of ' || p_name AS description, '"' || p_brand || '","' || p_brand || '","any"' AS enum_values FROM p
UNION ALL SELECT uri, '', 'size', 'integer', NULL, NULL FROM p UNION ALL SELECT uri, '', 'next', 'size', NULL, NULL FROM p UNION ALL SELECT uri, '', 'tags', 'array', NULL, NULL FROM p
""")
def schema_properties_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.catalog import schema_properties
    from conform.operators.schemagraph import schema_nodes

    rows = schema_properties(schema_nodes(part_schemas(spark, sf_dir)))
    return rows.select("uri", "owner", "name", "label", "description", F.array_join("enum_values", ",").alias("enum_values"))


@query("""
WITH p AS (SELECT 'https://parts.example/' || p_partkey || '.json' AS uri, p_size::VARCHAR AS v FROM part)
SELECT uri, '/definitions/size' AS owner, 'minimum' AS keyword, v AS value FROM p UNION ALL SELECT uri, '/definitions/size', 'exclusiveMinimum', 'true' FROM p UNION ALL SELECT uri, '/properties/tags/items/0', 'maxLength', v FROM p
""")
def schema_constraints_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.catalog import schema_constraints
    from conform.operators.schemagraph import schema_nodes

    return schema_constraints(schema_nodes(part_schemas(spark, sf_dir)))


@query("""
WITH p AS (SELECT 'https://parts.example/' || p_partkey || '.json' AS uri FROM part)
SELECT uri, rule, CAST(n AS BIGINT) AS n FROM p, (VALUES ('id', 1), ('definitions', 1), ('items_array', 1), ('boolean_bound', 1), ('dependencies', 1), ('required_mark', 1)) r(rule, n)
""")
def migrate_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.schemagraph import rule_hits, schema_nodes

    return rule_hits(schema_nodes(part_schemas(spark, sf_dir)))


@query("""
SELECT 'https://parts.example/' || p_partkey || '.json' AS src_uri, '/properties/next' AS src_path, 'https://parts.example/' || (p_partkey + 7) || '.json#/definitions/size' AS ref FROM part WHERE p_partkey + 7 NOT IN (SELECT p_partkey FROM part)
""")
def schema_dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.schemagraph import dangling_refs, ref_edges, schema_nodes

    nodes = schema_nodes(part_schemas(spark, sf_dir))
    return dangling_refs(ref_edges(nodes), nodes)


@query("""
SELECT 'https://parts.example/' || p_partkey || '.json' AS uri, 'size' AS name FROM part
""")
def schema_used_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.schemagraph import schema_nodes, used_definitions

    return used_definitions(schema_nodes(part_schemas(spark, sf_dir))).select("uri", "name")


@query("""
WITH e AS (SELECT p_brand AS dir, p_partkey, trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug FROM part)
SELECT dir || '/' || slug AS dest, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1
""")
def catalog_output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.catalog import output_collisions

    rows = t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), T.slugify(F.col("p_name"))).alias("dest"))
    return output_collisions(rows, "dest")


@query("""
SELECT window_start, instance_path, kind, count(*) AS n FROM (
SELECT date_trunc('hour', ts) AS window_start, '/value' AS instance_path, 'maximum' AS kind FROM events WHERE value > 100
UNION ALL SELECT date_trunc('hour', ts), '/event_type', 'enum' FROM events WHERE event_type = 'error') GROUP BY ALL
""")
def events_windowed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operators over a bounded table: the same plan that a stream runs."""
    from conform.streaming.checks import stream_violations, windowed_violations

    schema = {"properties": {"value": {"maximum": 100}, "event_type": {"enum": ["click", "view", "signup", "purchase"]}}}
    found = stream_violations(t(spark, sf_dir, "events"), schema, ["event_id", "ts"], ["value", "event_type"])
    return windowed_violations(found).select("window_start", "instance_path", "kind", "n")


# -- reports, annotation, stores --------------------------------------------


@query(_FINDINGS + """
SELECT 'error: ' || path || ': ' || message || CASE WHEN code = 'validation' THEN ' (at ' || ip || ')' ELSE '' END AS value FROM f
""")
def findings_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_report(_all_findings(spark, sf_dir))


@query("""
SELECT '::error file=orders/' || o_orderkey || '.json,line=2,col=3,title=/status::value is not one of: "F", "O"' AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT '::error file=orders/' || o_orderkey || '.json,line=3,col=3,title=/price::value is greater than the maximum of 450000' FROM orders WHERE o_totalprice > 450000
""")
def orders_command_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are found in the documents' text, which is joined back only to those with errors."""
    content = F.concat(F.lit('{\n  "status": "'), "o_orderstatus", F.lit('",\n  "price": '), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\n}"))
    docs = t(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"), content.alias("content"))
    schema = {"properties": {"status": {"enum": ["F", "O"]}, "price": {"maximum": 450000}}}
    found = V.validate_one(docs.withColumn("instance", S.parse_jsonc(F.col("content"))), schema, ["path"])
    return D.command_report(D.diagnostics([("validation", D.with_places(found, docs))]))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'skipped' WHEN event_type = 'view' THEN 'updated' ELSE 'annotated' END AS outcome,
 CASE WHEN event_type = 'click' THEN '{"$schema": "u", ' || substr(props, 2) ELSE '{"$schema": "https://schemas.example/props.json", ' || substr(props, 2) END AS new_content FROM events
""")
def events_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.annotate import annotate, annotated

    old = F.when(F.col("event_type") == "click", F.lit("u")).when(F.col("event_type") == "view", F.lit("old"))
    uri = F.when(F.col("event_type") != "click", F.lit("https://schemas.example/props.json")).otherwise(F.lit("u"))
    rows = t(spark, sf_dir, "events").select("event_id", F.lit("jsonc").alias("format"), F.coalesce(annotated(F.lit("jsonc"), F.col("props"), old), F.col("props")).alias("content"), old.alias("inline_uri"), uri.alias("schema_uri"))
    return annotate(rows, update=True).select("event_id", "outcome", "new_content")


@query("""
SELECT url AS uri, CASE WHEN page_id % 3 = 0 THEN '{"v":2}' ELSE '{"v":1}' END AS body, page_id % 3 = 0 AS changed, page_id % 3 = 1 AS stale FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
""")
def pages_schema_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the stored schemas has a new body, a third is old and was not landed, a third is fresh."""
    from conform.operators.incremental import refresh_schema_store

    at = lambda x: F.to_timestamp(F.lit(x))
    uris = t(spark, sf_dir, "pages").groupBy(F.col("url").alias("uri")).agg((F.min("page_id") % 3).alias("k"))
    store = uris.select("uri", F.lit('{"v":1}').alias("body"), F.when(F.col("k") == 2, at("2024-01-02 09:00:00")).otherwise(at("2024-01-01 00:00:00")).alias("fetched_at"))
    landed = uris.filter("k <> 1").select("uri", F.when(F.col("k") == 0, '{"v":2}').otherwise('{"v":3}').alias("body"), at("2024-01-02 10:00:00").alias("fetched_at"))
    return refresh_schema_store(store, landed, at("2024-01-02 10:00:00")).select("uri", "body", "changed", "stale")


@query("""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, turn FROM conversations)
SELECT 'c/' || conv_id || '.jsonl' AS path, coalesce(CAST(min(line) FILTER (turn % 5 = 3) AS BIGINT), 0) AS first_bad, count(*) AS lines FROM r GROUP BY conv_id
""")
def conversations_rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first bad line rejects them, and the lines of all."""
    line = F.when(F.col("turn") % 5 == 3, F.lit("{bad")).otherwise(F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")))
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    files = rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("content"))
    lines = S.explode_jsonl(files)
    _, bad = S.jsonl_failures(lines)
    per = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    return per.join(bad.select("path", F.col("line").cast("long").alias("first_bad")), "path", "left").select("path", F.coalesce("first_bad", F.lit(0)).cast("long").alias("first_bad"), "lines")


@query("""
SELECT p_name AS n, min('Part ' || p_type) AS d, '**/*.' || lower(replace(p_brand, '#', '')) AS f, p_brand || '/' || p_partkey || '/' AS u, CASE WHEN p_size > 10 THEN p_type END AS g FROM part GROUP BY p_name, p_brand, p_partkey, p_size, p_type
""")
def part_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conform.operators.catalog import search_index

    rows = t(spark, sf_dir, "part")
    key = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    entries = rows.select(key.alias("name"), F.concat(F.lit("Part "), "p_type").alias("description"), F.concat(F.lit("https://s/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/latest.json")).alias("url"), F.array(F.concat(F.lit("**/*."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))).alias("file_match"))
    members = rows.filter("p_size > 10").select(F.col("p_type").alias("group"), key.alias("name"))
    return search_index(entries, members, "https://s/").withColumn("n", F.substring_index("n", "#", 1))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_violations(spark, sf_dir)

