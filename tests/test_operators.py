"""Documents, globs, resolution, reports, annotation, incremental checks, schema graphs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from conform.functions import text as T
from conform.functions import urls as U
from conform.functions.globs import escape_glob, glob_captures, glob_match, glob_to_regex, ordered_parts_match
from conform.operators import annotate as A
from conform.operators import catalog as K
from conform.operators import diagnostics as D
from conform.operators import incremental as I
from conform.operators import resolve as R
from conform.operators import schemagraph as G
from conform.operators import stats
from conform.sources import catalogs as C
from conform.sources import documents as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


GLOBS = [
    ("**", "", True), ("**/a.json", "a.json", True), ("**/a.json", "x/y/a.json", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("*.json", "x/a.json", False), ("a**b", "a/b", False), ("a**b", "axb", True), ("?", "/", False),
    ("[!a]", "b", True), ("[^a]", "a", False), ("[]x]", "]", True), ("[a-c]z", "bz", True), ("[z-a]", "m", False), ("{a,b{c,d}}", "bd", True), ("{a,b", "a", False), ("!a", "b", True), ("!!a", "a", True), (r"\*", "*", True), (r"\*", "a", False), ("a/b", "a\\b", True), ("[/]", "/", True), ("", "", True),
]


def test_globs(spark):
    df = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(GLOBS)], "i int, p string")
    for i, (g, p, want) in enumerate(GLOBS):
        assert df.filter(F.col("i") == i).select(glob_match(F.col("p"), g).alias("m")).first().m == want, (g, p)
    assert one(spark, glob_match(F.lit("A.JSON"), "*.json", ignore_case=True))
    assert one(spark, glob_captures(F.lit("src/a/b/x.ts"), "src/**/*.{ts,js}")) == ["a/b/", "x", "ts"]
    assert one(spark, glob_match(F.lit("[x]*"), one(spark, escape_glob(F.lit("[x]*")))))
    assert not glob_to_regex("{" * 11 + "a" + "}" * 11)[1] and "(?!)" in glob_to_regex("{" * 11 + "a" + "}" * 11)[0]
    assert one(spark, F.array(ordered_parts_match("**.github**", F.lit("x/.github/y")), ordered_parts_match("a**b", F.lit("axxb")), ordered_parts_match("a**b", F.lit("axbx")))) == [True, True, False]


def test_text_functions(spark):
    assert one(spark, T.slugify(F.lit("Über GitHub--Workflow (v2)"))) == "ber-github-workflow-v2"
    assert one(spark, T.linkify(F.lit("see http://a.b/c. (http://d) <https://e> x http://f;"))) == "see <http://a.b/c>. (http://d) <https://e> x <http://f>;"
    assert tuple(one(spark, T.line_col(F.lit("é1\nab"), F.lit(5)))) == (2, 2)
    assert one(spark, T.line_col_offset(F.lit("é1\nab"), F.lit(2), F.lit(2))) == 5
    assert tuple(one(spark, T.pointer_span(F.lit('{"é": 1, "name": 2}'), F.lit("/name")))) == (10, 6)
    assert tuple(one(spark, T.pointer_span(F.lit("# c\n\na: 1\n  name: 2\n"), F.lit("/a/name")))) == (12, 4)
    assert tuple(one(spark, T.pointer_span(F.lit("# c\n\n  a: 1\n"), F.lit("")))) == (7, 0)
    assert [one(spark, T.to_schema_pointer(F.lit(p))) for p in ("/properties/a", "$.a.b[0]", "a", "$['x.y']", "$", "$..a")] == ["/properties/a", "/properties/a/properties/b/items", "/properties/a", "/properties/x.y", "", None]
    assert one(spark, T.instance_prefix(F.lit("/properties/a/items/properties/b"))) == "/a/b"
    assert one(spark, T.normalize_path(F.lit("./a/../b/./c"))) == "b/c" and one(spark, T.normalize_path(F.lit("/a/../../b"))) == "/b"
    assert one(spark, T.encode_fragment(F.lit("x#/a b/{c}/%20"))) == "x#/a%20b/%7Bc%7D/%20"
    assert one(spark, T.label(F.lit(""), F.lit("/type"))) == "here in /type"
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2.0", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in order], "v string")
    assert [r.v for r in df.orderBy(T.version_key(F.col("v"))).collect()] == order


def test_url_functions(spark):
    join = lambda b, r: one(spark, U.url_join(F.lit(b), F.lit(r)))
    assert [join("https://a/b/c.json", r) for r in ("d.json", "../d.json#/x", "/e", "#/y", "https://z/q", "//h/p")] == ["https://a/b/d.json", "https://a/d.json#/x", "https://a/e", "https://a/b/c.json#/y", "https://z/q", "https://h/p"]
    assert [one(spark, U.filename_of(F.lit(u))) for u in ("https://a.b/x/y", "https://a.b/x.JSON?q", "https://a.b/")] == ["y.json", "x.JSON", "a.b.json"]
    assert one(spark, U.schema_page_url(F.lit("https://s/g/x/latest.json"), "https://s/")) == "g/x/" and one(spark, U.version_page_url(F.lit("https://s/g/x/1.json"), "https://s/")) == "g/x/1/" and one(spark, U.schema_page_url(F.lit("https://o/x"), "https://s/")) is None
    assert one(spark, U.expand_registry(F.lit("github:o/r")))[0].endswith("/o/r/main/catalog.json") and one(spark, U.expand_registry(F.lit("github:o/r/b/c"))) == ["https://raw.githubusercontent.com/o/r/b/c/catalog.json"]


DOCS = [
    (1, "config.json", '{"name": "x"}'), (2, "config.yaml", "# yaml-language-server: $schema=https://example.com/schema.json\nname: x\n"), (3, "config.yml", "$schema: https://example.com/schema.json\nname: x"), (4, "config.toml", '# :schema https://example.com/schema.json\nname = "x"'),
    (5, "missing.json", '{ // c\n "a": "x,]",}'), (6, "bad.json", "{oops"), (7, "bad.yaml", "a: [1\nb"), (8, "post.md", "<!-- c -->\n---\nname: 1\n---\ntext"), (9, "plain.md", "# text"), (10, "x.json5", "{name: 'y', /* c */ }"), (11, "x.bin", "{}"), (12, "empty.json", ""), (13, "n.json", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, path string, content string")


def test_normalize_and_inline_schemas(spark, docs):
    rows = {r.doc_id: r for r in S.normalize_documents(docs).select("*", F.to_json("instance").alias("j"), S.inline_schema(F.col("format"), F.col("content"), F.col("instance")).alias("u")).drop("instance").collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13}
    assert all(json.loads(rows[i].j)["name"] == "x" for i in (1, 2, 3, 4)) and json.loads(rows[5].j) == {"a": "x,]"} and json.loads(rows[8].j) == {"name": 1} and json.loads(rows[10].j) == {"name": "y"}
    assert rows[9].j == "null" and rows[6].parse_error is not None and rows[7].parse_error is not None and rows[1].parse_error is None
    assert [rows[i].u for i in (1, 2, 3, 4)] == [None] + ["https://example.com/schema.json"] * 3


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text("{}")
    (tmp_path / "a/.hid.yaml").write_text("a: 1")
    (tmp_path / "skip.json").write_text("{}")
    (tmp_path / "b.txt").write_text("t")
    (tmp_path / "bad.toml").write_bytes(b"\xff")
    rows = S.scan_documents(spark, [str(tmp_path), str(tmp_path / "a")], exclude=["**/skip.json"]).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.io_error is not None) for r in rows) == [("bad.toml", True), ("x.json", False)]


def test_jsonl(spark):
    df = spark.createDataFrame([(1, "a.jsonl", '﻿{"$schema":"s"}\r\n\n{"$schema":"é"}\n'), (2, "b.jsonl", "{}\nbad\n{")], "doc_id int, path string, content string")
    lines = S.explode_jsonl(df)
    assert sorted((r.doc_id, r.line, r.byte_offset) for r in lines.collect()) == [(1, 1, 3), (1, 3, 21), (2, 1, 0), (2, 2, 3), (2, 3, 7)]
    good, bad = S.jsonl_failures(lines)
    assert {r.path for r in good.collect()} == {"a.jsonl"} and [(r.path, r.line) for r in bad.collect()] == [("b.jsonl", 2)]
    assert [(r.line, r.expected, r.found) for r in S.jsonl_schema_mismatches(good).collect()] == [(3, "s", "é")]


def test_strategies_equal_the_plain_join(spark):
    entries = [(0, "a", "u0", ["tsconfig.json", "tsconfig.*.json"]), (1, "b", "u1", ["*.json", "**/*.{yml,yaml}", "!x.json"]), (2, "c", "u2", ["/etc/conf", ".github/**/*.yml", ""])]
    patterns = C.catalog_patterns(spark, entries)
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(["tsconfig.json", "p/tsconfig.json", "tsconfig.base.json", "a/b.json", "q.yaml", ".github/w/ci.yml", "/etc/conf", "none", "yml", "a.json/b", None])], "doc_id int, path string")
    rows = [sorted(R.resolve_catalog(paths, patterns, by_strategy=s).select("doc_id", "match.*").collect()) for s in (True, False)]
    assert rows[0] == rows[1] and [(r.doc_id, r.url) for r in rows[0]] == [(0, "u0"), (1, "u0"), (2, "u0"), (3, "u1"), (4, "u1"), (5, "u1"), (6, "u2")]


def test_settings(spark):
    child = C.Config.parse('exclude = ["a"]\n[schemas]\n"x.json" = "child"\n[rewrite]\n"http://" = "//"')
    parent = C.Config.parse('root = true\nexclude = ["b"]\nregistries = ["r", "r"]\n[schemas]\n"x.json" = "parent"\n"y.json" = "p"\n[[override]]\nfiles = ["*.x"]\nvalidate_formats = false')
    merged = C.merge_settings([child, parent, C.Config(exclude=["never"])])
    assert merged.exclude == ["a", "b"] and merged.schemas == {"x.json": "child", "y.json": "p"} and merged.registries == ["r"]
    with pytest.raises(ValueError):
        C.Config.parse("unknown = 1")
    chain = C.settings_chain(spark.createDataFrame([("", "top", False), ("a", "mid", True), ("a/b", "leaf", False)], "dir string, body string, root boolean"), spark.createDataFrame([("a/b/c",), ("z",)], "folder string"))
    assert sorted((r.folder, r["rank"], r.body) for r in chain.collect()) == [("a/b/c", 1, "leaf"), ("a/b/c", 2, "mid"), ("z", 1, "top")]
    src = spark.createDataFrame([("//s.json", "d/f.json", "mapping"), ("./s.json", "d/f.json", "inline"), ("s.json", "d/f.json", "catalog"), ("https://h/s", "d/f", "inline")], "u string, p string, s string")
    assert [r.x for r in src.select(R.resolve_uri_path(F.col("u"), F.col("p"), F.col("s"), "/root").alias("x")).collect()] == ["/root/s.json", "d/s.json", "/root/s.json", "https://h/s"]


def test_suggestions(spark):
    known = spark.createDataFrame([("p", i, k) for i, k in enumerate(["quantity", "ship-date", "colour", "abc"])], "parent string, ord int, known string")
    bad = spark.createDataFrame([("p", x) for x in ("quanttiy", "ship_date", "coulor", "zzzzzz", "ab")], "parent string, property string")
    assert {r.property: r.suggestion for r in R.suggest(bad, known, ["parent"]).collect()} == {"quanttiy": "quantity", "ship_date": "ship-date", "coulor": "colour", "zzzzzz": None, "ab": "abc"}


def test_reports(spark):
    found = spark.createDataFrame([("b\\x.json", "/name", "/type", "type", "50% bad\n"), ("a.json", "", "/required", "required", "m")], "path string, instance_path string, schema_path string, kind string, message string")
    placed = D.with_places(found, spark.createDataFrame([("b\\x.json", '{\n "name": 1}'), ("a.json", "{}")], "path string, content string"))
    rows = D.diagnostics([("validation", placed), ("io", spark.createDataFrame([("c", "gone")], "path string, message string"))])
    assert sorted(r.value for r in D.command_report(rows).collect()) == ["::error file=a.json,line=1,col=1,title=validation error::m", "::error file=b/x.json,line=2,col=2,title=/name::50%25 bad%0A", "::error file=c,line=1,col=1,title=io error::gone"]
    assert sorted(r.value for r in D.text_report(rows).collect())[0] == "error: a.json: m"
    many = spark.range(120).select(F.lit("f").alias("path"), F.lit("io").alias("code"), F.col("id").cast("string").alias("message"))
    notes = D.annotations(D.diagnostics([("io", many)]))
    assert [r["n"] for r in notes.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [50, 50, 20]
    assert "| `a.json` | 1 | m |" in D.markdown_summary(D.annotations(rows), 3, 9).first().summary
    assert tuple(D.summary(found, found.limit(0)).first()) == (2, 0, False)


def test_annotate(spark):
    rows = [(1, "jsonc", '{\n  "a": 1\n}', None, "u"), (2, "yaml", "a: 1\n", None, "u"), (3, "toml", "a = 1", "old", "u"), (4, "jsonc", '{"$schema": "old", "a": 1}', "old", "u"), (5, "markdown", "x", None, "u"), (6, "jsonc", "{}", None, "u"), (7, "jsonc", "{}", None, None)]
    df = spark.createDataFrame(rows, "id int, format string, content string, inline_uri string, schema_uri string")
    got = {r.id: (r.outcome, r.new_content) for r in A.annotate(df, update=True).collect()}
    assert got[1] == ("annotated", '{\n  "$schema": "u",\n  "a": 1\n}') and got[2] == ("annotated", "# yaml-language-server: $schema=u\na: 1\n") and got[5][0] == "skipped" and got[7][0] == "skipped"
    assert json.loads(got[4][1]) == {"$schema": "u", "a": 1} and got[4][0] == got[3][0] == "updated" and json.loads(got[6][1]) == {"$schema": "u"}
    assert A.annotate(df).filter("outcome = 'updated'").count() == 0


def test_incremental_equals_full(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(40)], "doc_id int, content string").withColumn("cache_key", I.cache_key(F.col("content"), F.lit("s"), F.lit(True)))
    calls = []

    def check(df):
        calls.append(df.count())
        return df.select("cache_key", F.array(F.length("content").cast("string")).alias("errors"))

    none = spark.createDataFrame([], "cache_key string, errors array<string>")
    done, fresh = I.incremental_validate(docs.filter("doc_id < 20"), none, check)
    again, more = I.incremental_validate(docs, fresh.filter("true"), check)
    assert calls == [7, 0] and again.count() == 40 and {r.status: r.n for r in I.status_counts(again).collect()} == {"hit": 40} and more.count() == 0
    ts = lambda s: F.to_timestamp(F.lit(s))
    store = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "uri string, body string").withColumn("fetched_at", F.when(F.col("uri") == "c", ts("2024-01-02 09:00:00")).otherwise(ts("2024-01-01 00:00:00")))
    landed = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "9"), ("d", "4")], "uri string, body string").withColumn("fetched_at", ts("2024-01-02 10:00:00"))
    got = {r.uri: (r.body, r.changed, r.stale) for r in I.refresh_schema_store(store, landed, ts("2024-01-02 10:00:00")).collect()}
    assert got == {"a": ("2", True, False), "b": ("1", False, False), "c": ("1", False, False), "d": ("4", True, False)}


def test_schema_graph_and_migration(spark):
    bodies = {
        "https://h/a.json": {"$schema": "http://json-schema.org/draft-04/schema#", "id": "https://h/a.json", "title": "A", "properties": {"x": {"$ref": "b.json#/definitions/n"}, "y": {"required": True, "$ref": "#/definitions/k", "examples": 3}, "z": ["p", "q"]}, "definitions": {"k": {"minimum": 1, "exclusiveMinimum": True, "deprecated": "yes"}, "description": "d", "unused": {}}},
        "https://h/b.json": {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {"n": {"$ref": "https://h/a.json"}}, "required": "x"},
    }
    store = C.schema_store(spark, bodies)
    nodes = G.schema_nodes(store)
    edges = G.ref_edges(nodes)
    assert sorted((r.src_uri[-6:], r.ref) for r in edges.collect()) == [("a.json", "#/definitions/k"), ("a.json", "b.json#/definitions/n"), ("b.json", "https://h/a.json")]
    resolved = G.resolve_relative_refs(edges, store.select("uri", F.col("uri").alias("canonical")))
    assert {r.resolved for r in resolved.collect()} == {"https://h/a.json", "https://h/b.json#/definitions/n", "https://h/a.json#/definitions/k"}
    assert {r.message for r in G.shape_errors(nodes).collect()} >= {"expected an array"}
    assert {r.ref for r in G.dangling_refs(edges, nodes).collect()} == {"b.json#/definitions/n"}
    out = {r.uri: json.loads(r.body) for r in G.migrate_schemas(store).collect()}
    a = out["https://h/a.json"]
    assert a["$id"] == "https://h/a.json" and a["required"] == ["y"] and a["type"] == "object" and a["description"] == "d" and a["$defs"]["k"] == {"exclusiveMinimum": 1, "deprecated": True}
    assert a["properties"]["x"]["$ref"] == "b.json#/definitions/n".replace("/definitions/", "/$defs/") and a["properties"]["y"] == {"$ref": "#/$defs/k", "examples": [3]} and a["properties"]["z"] == {"enum": ["p", "q"]} and a["$schema"] == G.NEWEST
    again = {r.uri: json.loads(r.body) for r in G.migrate_schemas(C.schema_store(spark, out)).collect()}
    assert again == out
    assert {(r.uri, r.name) for r in G.used_definitions(nodes).collect()} == {("https://h/a.json", "k")}
    merged = json.loads(G.merge_bodies(spark.createDataFrame([("u", '{"title":"l","required":["a"],"properties":{"p":1},"uniqueItems":false}')], "uri string, body string"), spark.createDataFrame([("u", '{"title":"r","required":["b","a"],"properties":{"p":2,"q":3},"uniqueItems":true,"type":"object"}')], "uri string, body string")).first().body)
    assert merged == {"title": "l", "required": ["a", "b"], "properties": {"p": 1, "q": 3}, "uniqueItems": True, "type": "object"}
    flat = C.schema_store(spark, {"u": {"properties": {"a": {}}, "allOf": [{"$ref": "#/$defs/d"}, {"properties": {"a": {}, "c": {}}}], "$defs": {"d": {"properties": {"b": {}}, "required": ["b"]}}}})
    assert sorted((r.kind, r.name, r["rank"]) for r in G.all_of_names(G.schema_nodes(flat)).collect()) == [("property", "a", 0), ("property", "b", 1), ("property", "c", 2), ("required", "b", 1)]
    assert {(r.root[-6:], r["name"]) for r in G.bundle_names(nodes).collect()} == {("b.json", "A"), ("a.json", "b.json")}


def test_descriptions_and_catalog(spark):
    body = {"properties": {"a": {"type": "array", "items": {"type": "string"}, "description": "one"}, "b": {"type": ["string", "null"], "default": 1}, "c": {"oneOf": [{"type": "null"}, {"$ref": "#/$defs/k"}]}}, "required": ["b"], "$defs": {"k": {"const": 5}}, "anyOf": [{"title": "T"}, {"type": "object"}, {}]}
    nodes = G.schema_nodes(C.schema_store(spark, {"u": body}))
    props = {r["name"]: (r.label, r.required, r.description) for r in K.schema_properties(nodes).collect()}
    assert props == {"a": ("string[]", False, "one"), "b": ("string | null", True, None), "c": ("null | k", False, None)}
    assert [r.label for r in K.schema_variants(nodes).filter("keyword = 'anyOf'").orderBy("ord").collect()] == ["T", "object", "variant"]
    assert [(r["name"], r.label) for r in K.schema_definitions(nodes).collect()] == [("k", "const: 5")]
    entries = spark.createDataFrame([(0, "n1", "d", "https://s/g/a/latest.json", ["*.yml", "x.toml"], {"1.2.0": "v1", "1.10.0": "v2"}), (1, "n2", None, "https://o/b", [], {})], "entry_ord int, name string, description string, url string, file_match array<string>, versions map<string,string>")
    assert [r.version for r in K.latest_versions(entries, spark.createDataFrame([("https://s/g/a/latest.json", "B"), ("v1", "B"), ("v2", "B")], "uri string, body string")).collect()] == ["1.10.0"]
    members = spark.createDataFrame([("g", "n1")], "group string, name string")
    assert [(r.n, r.u, r.g, r.f) for r in K.search_index(entries, members, "https://s/").collect()] == [("n1", "g/a/", "g", "*.yml, x.toml")]
    groups, left = K.groups_of(entries, members)
    assert [r["name"] for r in left.collect()] == ["n2"]
    doc = json.loads(K.catalog_document(entries, groups, "t").first().value)
    assert [s["name"] for s in doc["schemas"]] == ["n1", "n2"] and doc["groups"] == [{"name": "g", "schemas": ["n1"]}]
    assert one(spark, K.parsers_of(F.array(F.lit("*.yml"), F.lit("a.toml"), F.lit("**/b.yaml"), F.lit("noext")))) == ["toml", "yaml"]
    fine, several = K.classify_entries(entries, spark.createDataFrame([("d1", "url", "https://o/b"), ("d2", "match", "**.toml")], "dir string, kind string, pattern string"), "src")
    assert sorted((r["name"], r.dir) for r in fine.collect()) == [("n1", "d2"), ("n2", "d1")] and several.count() == 0


def test_stats(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 5.0, 2.0, 2.0)] + [("b", 3.0)], "k string, v double")
    assert sorted((r.k, r.mean, r.least, r.most, r["median"], r.runs) for r in stats.timing_stats(df, ["k"], "v").collect()) == [("a", 2.5, 1.0, 5.0, 2.0, 4), ("b", 3.0, 3.0, 3.0, 3.0, 1)]


def test_stream(spark, tmp_path):
    from conform.streaming.checks import stream_violations, windowed_violations

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    found = windowed_violations(stream_violations(stream, {"properties": {"value": {"maximum": 100}}}, ["event_id", "ts"], ["value"]))
    q = found.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM found").first().n == src.filter("value > 100").count()
