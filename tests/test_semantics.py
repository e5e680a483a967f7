"""Rules that are easily got wrong: long and deep values, chains of references, repairs of patterns, bundles, names that clash."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conform.functions import numbers as N
from conform.functions.formats import check_format
from conform.functions.globs import pattern_rows
from conform.functions.regexes import repaired_regex
from conform.functions.values import VariantNode
from conform.operators import catalog as K
from conform.operators import incremental as I
from conform.operators import resolve as R
from conform.operators import schemagraph as G
from conform.operators import validate as V
from conform.plans.rules import Compiler
from conform.sources import catalogs as C
from conform.sources import documents as S
from conform.streaming.checks import validate_stream


def documents(spark, values):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, content string").withColumn("instance", S.parse_jsonc(F.col("content")))


def found(rows):
    return sorted((r.doc_id, r.instance_path, r.kind) for r in rows.collect())


def test_long_strings_and_many_lines(spark):
    values = ['{ // c\n "a": "' + 'x\\"' * 500_000 + '", /* y */ "b": [1,],}', '{ // c\n "a": "' + "y" * 1_000_000, "# c\n" * 20_000 + "# yaml-language-server: $schema=abc\nx: 1\n", "\n" * 20_000 + "x"]
    df = documents(spark, values)
    assert [r.n for r in df.orderBy("doc_id").select(F.length(F.to_json("instance")).alias("n")).collect()] == [1_500_016, None, None, None]
    assert df.orderBy("doc_id").select(F.length(F.to_json(S.parse_json5(F.col("content")))).alias("n")).first().n == 1_500_016
    assert [r.u for r in df.orderBy("doc_id").select(S.inline_schema(F.lit("yaml"), F.col("content"), F.parse_json(F.lit("{}"))).alias("u")).collect()] == [None, None, "abc", None]


def test_reference_chains_have_no_limit(spark):
    chain = {"$defs": {f"d{i}": {"$ref": f"#/$defs/d{i + 1}"} for i in range(20)} | {"d20": {"type": "integer"}}, "properties": {"x": {"$ref": "#/$defs/d0"}}}
    assert found(V.validate_one(documents(spark, [{"x": "no"}, {"x": 1}]), chain)) == [(0, "/x", "type")]
    nodes = G.schema_nodes(C.schema_store(spark, {"u": chain, "v": {"a": {"$ref": "#/b"}, "b": {"$ref": "#/a"}}}))
    wanted = spark.createDataFrame([("u", "/properties/x")], "uri string, id string")
    assert [(r.id, r.found) for r in G.lookup_pointer(nodes, wanted).collect()] == [("/properties/x", "/$defs/d20")]


@pytest.mark.parametrize("depth", [3, 30])
def test_recursive_references_reach_every_level(spark, depth):
    tree = {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "additionalProperties": False}
    value = {"v": "bad", "w": 1}
    for _ in range(depth):
        value = {"v": 1, "kids": [{"v": 2}, value]}
    place = "/kids/1" * depth
    assert found(V.validate_one(documents(spark, [value]), tree)) == [(0, place + "/v", "type"), (0, place + "/w", "additional_property")]
    nodes = S.explode_nodes(documents(spark, [value]), deepest=5)
    assert nodes.agg(F.max("depth")).first()[0] == 2 * depth + 1 and nodes.count() == 5 * depth + 3 and nodes.select("pointer").distinct().count() == nodes.count()


def wrapped(value, depth, key="c"):
    for _ in range(depth):
        value = {key: value} if key else [value]
    return value


def test_branches_are_decided_at_any_depth(spark):
    tree = {"anyOf": [{"type": "integer"}, {"type": "object", "properties": {"c": {"$ref": "#"}}}]}
    assert found(V.validate_one(documents(spark, [wrapped("x", 12), wrapped(1, 12), {"c": 1}]), tree)) == [(0, "", "any_of")]
    lists = {"type": ["array", "integer"], "contains": {"$ref": "#"}}
    assert found(V.validate_one(documents(spark, [wrapped(1, 15, None), wrapped("a", 15, None)]), lists)) == [(1, "", "contains")]


def test_plans_grow_with_the_schema(spark):
    ten = {"type": "object", "properties": {f"p{i}": {"$ref": "#"} for i in range(10)} | {"v": {"type": "integer"}}}
    compiler = Compiler()
    compiler.compile(ten, VariantNode(F.col("v")), bad=F.array().cast("array<string>"))
    assert len(compiler.places) == 1
    value = wrapped(wrapped({"v": "x"}, 4, "p3"), 4, "p9")
    assert found(V.validate_one(documents(spark, [value, wrapped({"v": 1}, 8, "p1")]), ten)) == [(0, "/p9" * 4 + "/p3" * 4 + "/v", "type")]
    shared = {"$defs": {f"l{i}": {"properties": {k: {"$ref": f"#/$defs/l{i + 1}"} for k in "ab"}} for i in range(9)} | {"l9": {"type": "integer"}}, "$ref": "#/$defs/l0"}
    both = "x"
    for _ in range(9):
        both = {"a": both, "b": both}
    assert len(found(V.validate_one(documents(spark, [both]), shared))) == 2**9


def test_several_schemas_and_tables_go_below_one_expression(spark):
    tree = {"properties": {"v": {"type": "integer"}, "c": {"$ref": "#"}}}
    docs = documents(spark, [wrapped({"v": "x"}, 15), wrapped({"v": "x"}, 15)]).withColumn("schema_uri", F.when(F.col("doc_id") == 0, "t").otherwise("u"))
    assert found(V.validate(docs, {"t": tree, "u": {"$ref": "t"}}, ["doc_id"])) == [(i, "/c" * 15 + "/v", "type") for i in (0, 1)]
    many = {f"s{i}": {"maximum": i} for i in range(45)}
    rows = documents(spark, list(range(60))).withColumn("schema_uri", F.concat(F.lit("s"), (F.col("doc_id") % 45).cast("string")))
    assert [i for i, _, _ in found(V.validate(rows, many, ["doc_id"]))] == list(range(45, 60))


def test_a_stream_finds_what_a_batch_finds(spark, tmp_path):
    tree = {"properties": {"v": {"type": "integer"}, "c": {"$ref": "#"}}}
    docs = documents(spark, [wrapped({"v": "x"}, d) for d in (1, 9, 15)] + [wrapped({"v": 1}, 15)]).select("doc_id", "content")
    docs.write.json(str(tmp_path / "in"))
    check = lambda df: V.validate_one(df.withColumn("instance", F.parse_json("content")), tree, ["doc_id"])
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    validate_stream(stream, check, str(tmp_path / "out"), str(tmp_path / "point")).awaitTermination(120)
    assert found(spark.read.parquet(str(tmp_path / "out"))) == found(check(docs)) == [(0, "/c/v", "type"), (1, "/c" * 9 + "/v", "type"), (2, "/c" * 15 + "/v", "type")]


def test_a_stream_reuses_what_it_has_checked(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 3}") for i in range(6)], "doc_id long, cache_key string").repartition(2).write.json(str(tmp_path / "in"))
    asked = []

    def check(df):
        asked.append(df.count())
        return df.select("cache_key", F.array(F.col("cache_key")).alias("errors"))

    stream = spark.readStream.schema("doc_id long, cache_key string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    validate_stream(stream, check, str(tmp_path / "out"), str(tmp_path / "point"), results=str(tmp_path / "results")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 6 and rows.filter("errors[0] <> cache_key").count() == 0 and sum(asked) == 3


@pytest.mark.parametrize(("value", "schema", "kinds"), [
    ("1e2", {"enum": [100]}, []), ("100.00", {"const": 1e2}, []), ("100.5", {"enum": [100, "100.5"]}, ["enum"]), ("9007199254740992", {"minimum": 9007199254740993}, ["minimum"]), ("-1e400", {"maximum": -10**399}, []),
    ("0.5", {"multipleOf": 1e-12}, []), ("5e-13", {"multipleOf": 1e-12}, ["multiple_of"]), ("100000000000000000000000000001", {"multipleOf": 2}, ["multiple_of"]), ("-7.5", {"multipleOf": 2.5}, []), ("-0.0", {"minimum": 0, "exclusiveMaximum": 0}, ["exclusive_maximum"]),
    ("-12", {"minimum": -11.5}, ["minimum"]), ("-1.25", {"exclusiveMinimum": -1.250}, ["exclusive_minimum"]), ("[1, 1.0]", {"uniqueItems": True}, ["unique_items"]), ("[1, 1e0]", {"uniqueItems": True}, ["unique_items"]), ('{"a": [1e1]}', {"const": {"a": [10]}}, []), ('["x.0"]', {"const": ["x.0"]}, []),
])
def test_numbers_are_what_their_literals_say(spark, value, schema, kinds):
    docs = spark.createDataFrame([(0, value)], "doc_id int, t string").select("doc_id", F.try_parse_json("t").alias("instance"))
    assert [k for _, _, k in found(V.validate_one(docs, schema))] == kinds


def test_normal_forms_order_as_numbers(spark):
    texts = ["0", "-0.0", "1", "1.50", "15e-1", "-1.5", "-15", "1e30", "123456789012345678901234567890", "1e-12", "-1e-12", "99.9", "100", "-99.9", "-100", "0.001"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.normal_form(F.col("t")).alias("f")).collect()
    for a in rows:
        assert a.f == N.form_of(Decimal(a.t))
        assert all((a.f < b.f) == (Decimal(a.t) < Decimal(b.t)) and (a.f == b.f) == (Decimal(a.t) == Decimal(b.t)) for b in rows)
    assert spark.range(1).select(N.normal_form(F.lit("NaN"))).first()[0] is None


def test_drafts_decide_which_keywords_count(spark):
    docs = documents(spark, [5, 6])
    assert found(V.validate_one(docs, {"$schema": "http://json-schema.org/draft-04/schema#", "minimum": 5, "exclusiveMinimum": True})) == [(0, "", "exclusive_minimum")]
    old = {"$schema": "http://json-schema.org/draft-07/schema#", "$ref": "#/definitions/n", "maximum": 1, "definitions": {"n": {"maximum": 5}}}
    assert found(V.validate_one(docs, old)) == [(1, "", "maximum")]
    assert found(V.validate_one(docs, old | {"$schema": "https://json-schema.org/draft/2020-12/schema"})) == [(0, "", "maximum"), (1, "", "maximum"), (1, "", "maximum")]


def test_patterns_are_found_by_what_they_hold(spark):
    patterns = ["src/**", "src/**/*.ts", "**/a/b.json", "**/*.config.json", "**/vendor/**", "*mid*", "**/[ab]*.txt", "{x,y}/**/z.json", "!src/**", "a?c/d", "pre*post", "\\*lit*", "**", "[]x]a/b"]
    rows = pattern_rows(spark, list(enumerate(patterns)), ["ord", "pattern"])
    parts = ["src", "a", "b.json", "vendor", "x.config.json", "z.json", "xmidy", "afoo.txt", "abc", "d", "prepost", "pre-post", "*lit9", "m.ts", "]a", "b", "x"]
    docs = spark.createDataFrame([(i * 17 + j, f"{a}/{b}" if (i + j) % 3 else a) for i, a in enumerate(parts) for j, b in enumerate(parts)], "doc_id int, path string")
    pairs = lambda df: sorted(set(map(tuple, df.select("doc_id", "ord").collect())))
    assert pairs(R.all_matches(docs, rows)) == pairs(R.all_matches_by_strategy(docs, rows))
    many = pattern_rows(spark, [(i, f"d{i}/**/*.x{i}") for i in range(3000)], ["ord", "pattern"])
    plan = R.all_matches_by_strategy(docs, many)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert [r.doc_id for r in R.matching_any(docs.filter("doc_id < 3"), rows.filter("pattern = 'src/**'")).orderBy("doc_id").collect()] == [r.doc_id for r in docs.filter("doc_id < 3 AND path LIKE 'src/%'").orderBy("doc_id").collect()]


def test_nearest_names_without_all_pairs(spark):
    import random

    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    sought = spark.createDataFrame([(i % 2, name()) for i in range(200)] + [(0, "color"), (2, "é")], "k int, property string").distinct()
    known = spark.createDataFrame([(i % 2, name(), i) for i in range(80)] + [(0, "colour", 90), (2, "ö", 91)], "k int, known string, ord int")
    d = F.levenshtein(F.lower("property"), F.lower("known"), 3)
    near = sought.join(known, "k").withColumn("d", d).filter((F.col("d") >= 0) & (F.col("d") * 2 <= F.greatest(F.octet_length("property"), F.octet_length("known"))))
    want = {(r.k, r.property): r.s for r in near.groupBy("k", "property").agg(F.min_by("known", F.struct("d", "ord")).alias("s")).collect()}
    got = {(r.k, r.property): r.suggestion for r in R.suggest(sought, known, ["k"]).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and got[0, "color"] == "colour" and got[2, "é"] == "ö"


def test_where_json_breaks(spark):
    cases = {'{"a" 1}': 5, "[1,2,,3]": 5, "[1,2,]": None, '{"a":tru}': 5, '{"é":"x" "b"}': 10, '{"a":[1,2}': 9, "": 0, "{bad": 1, '"\\x"': 0, '{"a":1 /* c */, // d\n "b":]}': 26, '\ufeff{"a":;}': 8, '{"a":{"b":[': 11, '"' + "x" * 200_000: 0, "[" * 500: 500}
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").withColumn("e", S.syntax_error(F.col("t"))).collect()
    assert all(r.e == r.n for r in rows), [(r.t[:20], r.e, r.n) for r in rows if r.e != r.n]


def test_catalogs_fail_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "schemas": [{"name": "n", "url": "u"}]}')
    (tmp_path / "b.json").write_text('{"schemas": [{')
    entries, warnings = C.read_catalogs(spark, [str(tmp_path / x) for x in ("b.json", "a.json", "none.json")])
    assert [(r.cat_ord, r.name, r.file_match) for r in entries.collect()] == [(1, "n", [])]
    assert sorted((r.cat_ord, r.message) for r in warnings.collect()) == [(0, "catalog skipped: malformed JSON"), (2, "catalog skipped: cannot be read")]


def test_settings_fold_as_on_the_driver(spark):
    configs = {"": C.Config(True, ["x"], {"a": "1", "b": "1"}, registries=["r", "s"]), "p": C.Config(False, ["y"], {"a": "2"}, registries=["s", "t"]), "p/q": C.Config(True, ["z"], {"c": "3"})}
    rows = spark.createDataFrame([(d, c.root, c.exclude, c.schemas, c.registries) for d, c in configs.items()], "dir string, root boolean, exclude array<string>, schemas map<string,string>, registries array<string>")
    lists, maps = C.folded_settings(rows, spark.createDataFrame([("p",), ("p/q/r",), ("o",), ("p",)], "folder string"))
    chains = {"p": ["p", ""], "p/q/r": ["p/q"], "o": [""]}
    want = {f: C.merge_settings([configs[d] for d in c]) for f, c in chains.items()}
    assert {r.folder: (r.exclude, r.registries) for r in lists.collect()} == {f: (c.exclude, c.registries) for f, c in want.items()}
    found_maps: dict = {}
    for r in maps.collect():
        found_maps.setdefault(r.folder, {})[r.key] = r.value
    assert found_maps == {f: c.schemas for f, c in want.items()}


def test_did_you_mean_in_the_message(spark):
    schema = {"$defs": {"base": {"properties": {"colour": True, "Weight": True}}}, "allOf": [{"$ref": "#/$defs/base"}], "properties": {"length": True}, "additionalProperties": False}
    rows = V.validate_one(documents(spark, [{"lenght": 1, "coler": 2, "weigt": 3, "zzzzzzzz": 4}]), schema)
    said = {r.params["property"]: r.message for r in rows.collect()}
    assert said == {k: f"Additional properties are not allowed ('{k}' was unexpected){h}" for k, h in {"lenght": "; did you mean 'length'?", "coler": "; did you mean 'colour'?", "weigt": "; did you mean 'Weight'?", "zzzzzzzz": ""}.items()}
    nodes = G.schema_nodes(C.schema_store(spark, {"u": schema, "v": {"$ref": "#/$defs/r", "$defs": {"r": {"allOf": [{"$ref": "#/$defs/r"}], "properties": {"q": {}}}}}}))
    names = G.property_names_at(nodes, spark.createDataFrame([("u", ""), ("v", "")], "uri string, id string"))
    assert sorted((r.uri, r["name"]) for r in names.collect()) == [("u", "Weight"), ("u", "colour"), ("u", "length"), ("v", "q")]


def test_unknown_extensions_try_all_formats(spark):
    texts = {"a": "a = 1\nb = 2\n", "b": "a: 1\n", "c": "[s]\nk = 1", "d": "---\nt: 1\n---\n# h\n", "e": '{"a": 1,}', "f": "plain words", "g": "{a: .5, 'b': \"//\", // c\n}"}
    df = spark.createDataFrame([(k, k + ".x", v) for k, v in texts.items()], "k string, path string, content string")
    got = {r.k: (r.format, json.loads(r.j)) for r in S.normalize_documents(df, F.lit(True)).select("k", "format", F.to_json("instance").alias("j")).collect()}
    assert got == {"a": ("toml", {"a": 1, "b": 2}), "b": ("yaml", {"a": 1}), "c": ("toml", {"s": {"k": 1}}), "d": ("markdown", {"t": 1}), "e": ("jsonc", {"a": 1}), "g": got["g"]} and got["g"][1]["b"] == "//"
    assert S.normalize_documents(df).count() == 0


def test_skipped_documents_are_counted(spark):
    df = spark.createDataFrame([(1, "null", "u"), (2, "{}", None), (3, "{}", "u"), (4, "null", None), (5, "3", "u")], "doc_id int, j string, schema_uri string").withColumn("instance", F.parse_json("j"))
    fine, skipped = S.checkable(df)
    assert {r.doc_id for r in fine.collect()} == {3, 5} and {r.reason: r.n for r in skipped.collect()} == {"null": 2, "no schema": 1}
    assert [(r.schema_uri, r.documents) for r in S.group_sizes(df).collect()] == [("u", 3)]


def test_patterns_are_repaired_once(spark):
    cases = {"^a$": "^a$", "^{x}$": r"^\{x\}$", "a{2,3}b{": r"a{2,3}b\{", r"\Aq\Z": "^q$", r"x[\s-:]+": r"x[\s\-:]+", r"[q\w-]": r"[q\w-]", "k[x[y]*": r"k[x\[y]*", r"\p{L}{2}": r"\p{L}{2}", "[]a]": "[]a]", r"\{2}": r"\{2\}", "[{}]": "[{}]"}
    for pattern, want in cases.items():
        assert repaired_regex(pattern) == want == repaired_regex(want)
    body = {"$schema": "http://json-schema.org/draft-07/schema#", "patternProperties": {k: {"pattern": k} for k in cases}}
    once = {r.uri: json.loads(r.body) for r in G.migrate_schemas(C.schema_store(spark, {"u": body})).collect()}
    assert once["u"]["patternProperties"] == {v: {"pattern": v} for v in cases.values()}
    assert {r.uri: json.loads(r.body) for r in G.migrate_schemas(C.schema_store(spark, once)).collect()} == once


def test_deep_and_nested_definitions_are_migrated(spark):
    deep = {"definitions": {"k": {"type": "integer", "minimum": 1, "exclusiveMinimum": True}}}
    for _ in range(20):
        deep = {"properties": {"p": deep}}
    boxed = {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"ns": {"a": {"definitions": {"z": True}, "type": "string"}, "b": True}, "b": {"type": "null"}}, "properties": {"q": {"$ref": "#/definitions/ns/a"}, "r": {"$ref": "#/definitions/ns/a/definitions/z"}}}
    once = {r.uri: json.loads(r.body) for r in G.migrate_schemas(C.schema_store(spark, {"u": deep, "v": boxed})).collect()}
    at = once["u"]
    for _ in range(20):
        at = at["properties"]["p"]
    assert at["$defs"]["k"] == {"type": "integer", "exclusiveMinimum": 1}
    assert once["v"]["$defs"] == {"a": {"$defs": {"z": True}, "type": "string"}, "b": {"type": "null"}}
    assert once["v"]["properties"]["q"] == {"$ref": "#/$defs/a"} and once["v"]["properties"]["r"] == {"$ref": "#/$defs/a/$defs/z"}
    assert {r.uri: json.loads(r.body) for r in G.migrate_schemas(C.schema_store(spark, once)).collect()} == once


def test_flattening_and_bundling(spark):
    root = {"title": "R", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": False, "allOf": [{"$ref": "#/$defs/d"}, {"properties": {"a": {}, "c": {}}, "required": ["c"], "deprecated": True, "additionalProperties": True}],
            "$defs": {"d": {"title": "D", "properties": {"b": {"$ref": "#/$defs/e"}}, "required": ["b", "a"]}, "e": {"type": "null"}, "unused": {"$ref": "#/$defs/unused"}}}
    flat = json.loads(G.flatten_all_of(C.schema_store(spark, {"u": root})).first().body)
    assert flat["properties"] == {"a": {"type": "string"}, "b": {"$ref": "#/$defs/e"}, "c": {}} and flat["required"] == ["a", "b", "c"] and flat["deprecated"] is True and flat["additionalProperties"] is False
    assert flat["title"] == "R" and flat["allOf"] == root["allOf"] and set(flat["$defs"]) == {"d", "e"}
    bodies = {
        "https://h/a.json": {"properties": {"x": {"$ref": "b.json#/$defs/n"}, "y": {"$ref": "https://h/c.json"}, "z": {"$ref": "https://h/lost.json"}}, "$defs": {"mine": {"type": "string"}}},
        "https://h/b.json": {"title": "Bee", "$defs": {"n": {"type": "integer"}, "mine": {"type": "null"}}, "properties": {"q": {"$ref": "#/$defs/n"}}},
        "https://h/c.json": {"type": "array", "items": {"$ref": "https://h/d.json"}},
        "https://h/d.json": {"type": "boolean"},
    }
    out = {r.uri: json.loads(r.body) for r in G.bundle_schemas(C.schema_store(spark, bodies)).collect()}
    a = out["https://h/a.json"]
    assert a["properties"] == {"x": {"$ref": "#/$defs/Bee/$defs/n"}, "y": {"$ref": "#/$defs/c.json"}, "z": {"$ref": "https://h/lost.json"}}
    assert set(a["$defs"]) == {"mine", "n", "Bee", "c.json", "d.json"} and a["$defs"]["mine"] == {"type": "string"} and a["$defs"]["Bee"]["x-source"] == "https://h/b.json"
    assert a["$defs"]["c.json"]["items"] == {"$ref": "#/$defs/d.json"} and out["https://h/d.json"] == bodies["https://h/d.json"]


def test_properties_are_described_by_what_they_refer_to(spark):
    body = {"$defs": {"k": {"$ref": "#/$defs/m"}, "m": {"type": "integer", "description": "whole", "default": 3, "examples": [1, 2]}, "l": {"type": "array", "items": {"type": "array", "items": {"type": "string"}}}},
            "properties": {"p": {"$ref": "#/$defs/k"}, "q": {"$ref": "#/$defs/l"}, "o": {"$ref": "https://o/x.json"}}, "required": ["p"]}
    nodes = G.schema_nodes(C.schema_store(spark, {"u": body, "v": {"properties": {"p": {}}}}))
    got = {r["name"]: (r.label, r.description, r.default_value, r.examples, r.required) for r in K.schema_properties(nodes).filter("uri = 'u'").collect()}
    assert got == {"p": ("integer", "whole", "3", ["1", "2"], True), "q": ("string[][]", None, None, None, False), "o": ("x.json", None, None, None, False)}
    errors = spark.createDataFrame([("u", "/p"), ("u", "/p/x"), ("u", "/px"), ("v", "/p"), ("w", "/p")], "schema_uri string, instance_path string")
    assert sorted((r.uri, r["name"], r.errors) for r in K.explain(nodes, errors, "").collect()) == [("u", "o", 0), ("u", "p", 2), ("u", "q", 0), ("v", "p", 1)]


def test_results_of_a_repeated_run_replace_its_own(spark, tmp_path):
    rows = spark.createDataFrame([("aa1", ["x"]), ("bb2", [])], "cache_key string, errors array<string>")
    for run, part in (("r1", rows), ("r1", rows), ("r2", rows.filter("cache_key = 'aa1'").withColumn("errors", F.array(F.lit("y"))))):
        I.store_results(part, str(tmp_path / "results"), run)
    kept = I.load_results(spark, str(tmp_path / "results"))
    assert {r.cache_key: r.errors for r in kept.collect()} == {"aa1": ["y"], "bb2": []} and kept.count() == 2
    hits, misses = I.split_by_cache(spark.createDataFrame([("aa1",), ("cc3",)], "cache_key string"), rows.union(rows))
    assert hits.count() == 1 and misses.count() == 1


def test_overrides_take_paths_without_a_leading_dot(spark):
    df = spark.createDataFrame([("./a/es.json",), ("a/es.json",), ("b.json",)], "path string").withColumns({"schema_uri": F.lit("u"), "original_uri": F.lit("u")})
    assert {r.path: r.validate_formats for r in R.format_checks(df, [(0, ["a/*.json"], [], False)]).collect()} == {"./a/es.json": False, "a/es.json": False, "b.json": True}


def test_prefixes_and_file_names(spark):
    rows = spark.createDataFrame([("abc",), ("ab",), ("",), (None,)], "t string")
    keys = spark.createDataFrame([("a",), ("abc",), ("b",), (None,)], "k string")
    assert sorted((r.t, r.k) for r in R.prefix_join(rows, keys, "t", "k").collect()) == [("ab", "a"), ("abc", "a"), ("abc", "abc")]
    assert R.prefix_join(rows, keys.limit(0), "t", "k").count() == 0
    urls = ["https://a/x.json", "https://b/x.json", "https://c/x-2.json", "https://d/x.json", "https://e/x-3.json"]
    df = spark.createDataFrame([(i, "f", u) for i, u in enumerate(urls)], "o int, folder string, url string")
    names = {r.o: r.file for r in K.unique_filenames(df, "folder", "url", "o").collect()}
    assert len(set(names.values())) == 5 and names[0] == "x.json" and names[2] == "x-2.json" and names[4] == "x-3.json"
    patterns = C.catalog_patterns(spark, [(0, "n", "u", ["*.json", "x*"])])
    assert [r.path for r in R.matching_any(spark.createDataFrame([("x.json",), ("y",)], "path string"), patterns).collect()] == ["x.json"]


FORMATS = {
    "regex": (["^a+$", "(x|y)"], ["(", "a**+{"]), "iri": (["https://é.example/ü"], ["é", "https://a b"]), "iri-reference": (["ü/x#y"], ["a b", "%zz"]), "uri": (["https://e.example/%20"], ["https://é.example"]),
    "idn-email": (["é@bücher.example"], ["é @x", "nobody"]), "idn-hostname": (["bücher.example"], ["-x.example", "a b"]), "uri-template": (["/a/{x}/{?y,z*}", "plain"], ["/a/{", "/{x y}"]),
}


def test_more_formats(spark):
    for name, (good, bad) in FORMATS.items():
        df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, want boolean")
        rows = df.select("x", "want", check_format(name, F.col("x")).alias("got")).collect()
        assert all(r.got == r.want for r in rows), (name, rows)


def test_schemas_from_a_table(spark):
    bodies = {"u": {"$ref": "v"}, "v": {"type": "integer"}, "unused": {}, "odd": {"$ref": "a b"}}
    docs = documents(spark, ["1", '"x"']).withColumn("schema_uri", F.lit("u")).withColumn("path", F.lit("p"))
    schemas = V.schemas_of(docs, C.schema_store(spark, bodies))
    assert set(schemas) == {"u", "v"} and found(V.validate(docs, schemas)) == [(1, "", "type")]
    odd = docs.withColumn("schema_uri", F.lit("odd"))
    assert {r.code for r in V.schema_findings(odd, bodies).collect()} == {"schema_compile"} and V.schema_findings(odd, bodies, formats={"odd": False}).count() == 0
    errors = spark.createDataFrame([("a", "pointer '/x' does not exist"), ("b", "unresolved reference #/q")], "uri string, message string")
    entries = spark.createDataFrame([("a", "s", "{}", ["*.json"], None), ("b", "s", "{}", [], None)], "url string, source_url string, body string, file_match array<string>, description string")
    assert {r.url: r.provenance.invalid for r in K.with_provenance(entries, errors).collect()} == {"a": False, "b": True}
    one = spark.createDataFrame([(1, "x"), (0, "y")], "entry_ord int, url string")
    assert [(r.entry_ord, r.url) for r in K.united_entries([one, one.withColumn("extra", F.lit(1)), spark.createDataFrame([(0, "z")], "entry_ord int, url string")]).orderBy("entry_ord").collect()] == [(0, "y"), (1, "x"), (2, "z")]
