"""The keywords of JSON Schema over VARIANT and typed values, each with a value that passes and one that does not."""

import pytest
from pyspark.sql import functions as F

from conform.functions.regexes import java_regex
from conform.functions.values import VariantNode
from conform.operators import validate as V
from conform.plans.rules import CUSTOM, Compiler, register_rule


@pytest.fixture(scope="module")
def errors(spark):
    def run(schema, *docs, **options):
        df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, c string").select("i", F.try_parse_json("c").alias("v"))
        found = Compiler(**options).compile(schema, VariantNode(F.col("v")))
        return [[(e.instance_path, e.kind) for e in r.e] for r in df.select("i", found.alias("e")).orderBy("i").collect()]

    return run


CASES = [
    ({"type": "integer"}, "1.0", "1.5", "type"), ({"type": ["string", "null"]}, "null", "1", "type"), ({"enum": [1, "a", None, {"b": 1, "a": [2]}]}, '{"a":[2.0],"b":1}', '"1"', "enum"), ({"const": 1}, "1.0", "true", "constant"),
    ({"minimum": 2}, "2", "1.9", "minimum"), ({"maximum": 2}, '"x"', "3", "maximum"), ({"exclusiveMinimum": 2}, "2.1", "2", "exclusive_minimum"), ({"exclusiveMaximum": 2}, "1", "2", "exclusive_maximum"), ({"multipleOf": 0.1}, "0.3", "0.35", "multiple_of"),
    ({"minLength": 2}, '"é😀"', '"é"', "min_length"), ({"maxLength": 1}, '"😀"', '"ab"', "max_length"), ({"pattern": "b{"}, '"ab{"', '"ab"', "pattern"), ({"format": "ipv4"}, '"1.2.3.4"', '"1.2.3.400"', "format"), ({"format": "date"}, '"2024-02-29"', '"2023-02-29"', "format"),
    ({"format": "ipv6"}, '"::1"', '"1:::2"', "format"), ({"format": "uuid"}, '"123e4567-e89b-12d3-a456-426614174000"', '"123"', "format"), ({"format": "unknown"}, '"x"', None, None),
    ({"minItems": 1}, "[1]", "[]", "min_items"), ({"maxItems": 1}, "{}", "[1,2]", "max_items"), ({"uniqueItems": True}, '[1,"1"]', "[1,1.0]", "unique_items"), ({"contains": {"const": 1}, "minContains": 2}, "[1,1]", "[1]", "contains"),
    ({"prefixItems": [{"type": "string"}], "items": False}, '["a"]', '["a",1]', "false_schema"), ({"items": [{}], "additionalItems": False}, "[1]", "[1,2]", "additional_items"), ({"prefixItems": [True], "unevaluatedItems": False}, "[1]", "[1,2]", "unevaluated_items"),
    ({"required": ["a"]}, '{"a":null}', "{}", "required"), ({"additionalProperties": False, "properties": {"a": {}}}, '{"a":1}', '{"b":1}', "additional_property"), ({"patternProperties": {"^x": {"type": "string"}}}, '{"y":1}', '{"x":1}', "type"),
    ({"additionalProperties": {"type": "string"}, "patternProperties": {"^x": {}}}, '{"x":1,"a":"s"}', '{"a":1}', "type"), ({"propertyNames": {"maxLength": 1}}, '{"a":1}', '{"ab":1}', "property_names"), ({"minProperties": 1}, '{"a":1}', "{}", "min_properties"), ({"maxProperties": 0}, "{}", '{"a":1}', "max_properties"),
    ({"dependentRequired": {"a": ["b"]}}, '{"b":1}', '{"a":1}', "required"), ({"dependencies": {"a": {"required": ["b"]}}}, "{}", '{"a":1}', "required"), ({"dependentSchemas": {"a": {"maxProperties": 1}}}, '{"b":1,"c":1}', '{"a":1,"b":1}', "max_properties"),
    ({"allOf": [{"minimum": 2}, {"maximum": 3}]}, "2", "4", "maximum"), ({"anyOf": [{"minimum": 5}, {"type": "string"}]}, '"x"', "1", "any_of"), ({"oneOf": [{"minimum": 5}, {"minimum": 7}]}, "6", "8", "one_of_multiple_valid"), ({"oneOf": [{"minimum": 5}]}, "6", "4", "one_of_not_valid"),
    ({"not": {"type": "null"}}, "1", "null", "not"), ({"if": {"minimum": 5}, "then": {"maximum": 6}, "else": {"maximum": 1}}, "6", "7", "maximum"), ({"if": {"minimum": 5}, "then": {}, "else": {"maximum": 1}}, "1", "2", "maximum"), ({"properties": {"a": False}}, "{}", '{"a":1}', "false_schema"),
    ({"contentEncoding": "base64"}, '"YWI="', '"*"', "content_encoding"), ({"contentMediaType": "application/json"}, '"{}"', '"{"', "content_media_type"), ({"properties": {"a": True}, "unevaluatedProperties": False}, '{"a":1}', '{"b":1}', "unevaluated_properties"),
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": True}}], "unevaluatedProperties": False}, '{"b":1}', '{"a":2}', "unevaluated_properties"), ({"$defs": {"n": {"type": "null"}}, "$ref": "#/$defs/n"}, "null", "1", "type"),
    ({"$defs": {"n": {"$anchor": "here", "type": "null"}}, "$ref": "#here"}, "null", "1", "type"), ({"properties": {'a"b]': {"type": "null"}}}, '{"a\\"b]":null}', '{"a\\"b]":1}', "type"),
]


@pytest.mark.parametrize("chunk", [CASES[i::4] for i in range(4)])
def test_keywords(errors, chunk):
    for schema, good, bad, kind in chunk:
        found = errors(schema, good, *([bad] if bad is not None else []))
        assert found[0] == [], (schema, good, found[0])
        if bad is not None:
            assert [k for _, k in found[1]] == [kind], (schema, bad, found[1])


def test_paths_and_recursion(errors):
    tree = {"$defs": {"t": {"properties": {"kids": {"items": {"$ref": "#/$defs/t"}}, "v": {"type": "number"}}, "required": ["v"]}}, "$ref": "#/$defs/t"}
    assert errors(tree, '{"v":1,"kids":[{"v":"a"},{"kids":[{"v":2}]}]}')[0] == [("/kids/0/v", "type"), ("/kids/1", "required")]


def test_formats_can_be_off_and_rules_added(errors):
    assert errors({"format": "date"}, '"x"', formats=False) == [[]]
    register_rule("even", lambda node, want: (node.number() % 2 == 0) == F.lit(want), "value is not even")
    try:
        assert errors({"even": True}, "2", "3") == [[], [("", "custom")]]
    finally:
        CUSTOM.pop("even")


def test_store_references_and_findings(spark):
    schemas = {"https://a/s.json": {"properties": {"x": {"$ref": "t.json#/$defs/n"}}}, "https://a/t.json": {"$defs": {"n": {"type": "null"}}}, "https://a/bad.json": {"$ref": "#/nowhere"}}
    docs = spark.createDataFrame([(1, "a.json", "https://a/s.json", '{"x":1}'), (2, "b.json", "https://a/bad.json", "1"), (3, "c.json", "https://a/none.json", "1"), (4, "d.json", None, "1")], "doc_id int, path string, schema_uri string, c string").withColumn("instance", F.parse_json("c"))
    assert [(r.doc_id, r.instance_path, r.kind) for r in V.validate(docs, schemas).collect()] == [(1, "/x", "type")]
    assert sorted((r.path, r.code) for r in V.schema_findings(docs, schemas).collect()) == [("b.json", "schema_compile"), ("c.json", "schema_fetch")]


def test_typed_rows_equal_variant_rows(spark):
    schema = {"properties": {"a": {"minimum": 2, "multipleOf": 2}, "s": {"enum": ["x", 'q"\\']}, "l": {"items": {"maximum": 3}, "uniqueItems": True}}, "required": ["a", "zz"], "additionalProperties": False, "minProperties": 3}
    rows = spark.createDataFrame([(1, 1, "x", [1, 1]), (2, 4, 'q"\\', [9]), (3, None, None, None)], "id int, a int, s string, l array<int>")
    typed = V.validate_table(rows, schema, ["id"], ["a", "s", "l"])
    asJson = V.validate_one(rows.select("id", F.parse_json(F.to_json(F.struct("a", "s", "l"))).alias("instance")), schema, ["id"])
    order = lambda df: sorted((r.id, r.instance_path, r.kind, r.message) for r in df.collect())
    assert order(typed) == order(asJson) and len(order(typed)) == 9


def test_regex_dialect():
    assert [java_regex(p) for p in ("a{", "a{2,}", "[a[b]", r"[\w-.]", r"\Ax\Z", "x$", "}")] == [r"a\{", "a{2,}", r"[a\[b]", r"[\w\-.]", "^x$", r"x\z", r"\}"]
