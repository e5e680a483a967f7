"""Queries that were whole and right but too slow or too large for a driver: what made them so is gone."""

from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conform.functions import numbers as N
from conform.operators import validate as V
from conform.plans.queries import QUERIES
from conform.plans import deep_queries, schema_queries  # noqa: F401  (register their own)

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["numbers_exact", "events_unevaluated_items"])
def test_documents_are_parsed_once(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    plan = optimized(QUERIES[name](spark, SMALL))
    assert plan.lower().count("parsejson(") == (1 if name == "numbers_exact" else 2) and "Repartition" in plan


@pytest.mark.parametrize("step", [Decimal("0.25"), 2, 3, 7, Decimal("1.5e-12"), 123456789012345678901])
def test_remainders_by_pieces(spark, step):
    texts = ["0", "1", "3e0", "100000000000000000000000000021", "12345678901234567890123456789", "1e30", "6e-12", "750e-3", "-21", "246913578024691357802"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", N.is_multiple(N.literal_parts(F.col("x")), step).alias("m"))
    assert {r.x: r.m for r in rows.collect()} == {x: (Fraction(x) / Fraction(step)).denominator == 1 for x in texts}


def test_what_is_unevaluated_is_worked_out_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    schema = {"prefixItems": [{"type": "string"}], "anyOf": [{"prefixItems": [True, {"type": "number", "maximum": 50}]}, {"type": "array", "minItems": 9}], "unevaluatedItems": {"type": "boolean"}}
    rows = spark.createDataFrame([(1, '["a", 1, true, "x", 2]'), (2, '["a", 60, true]'), (3, '["a", 60, true, 4, 5, 6, 7, 8, "z"]')], "i int, j string").select("i", F.parse_json("j").alias("instance"))
    found = V.validate_one(rows, schema, ["i"])
    assert optimized(found).count("> 50") <= 3
    got = {(r.i, r.kind): r.params.get("unexpected") for r in found.collect()}
    assert got == {(1, "unevaluated_items"): '"x", 2', (2, "any_of"): None, (2, "unevaluated_items"): "60", (3, "unevaluated_items"): '60, 4, 5, 6, 7, 8, "z"'}
    props = {"properties": {"a": True}, "anyOf": [{"properties": {"b": {"type": "integer"}}}, {"patternProperties": {"^c": True}}], "unevaluatedProperties": False}
    rows = spark.createDataFrame([(1, '{"a":1,"b":2,"c1":3,"d":4}'), (2, '{"a":1,"b":"x","c":1}'), (3, "{}"), (4, "7")], "i int, j string").select("i", F.parse_json("j").alias("instance"))
    assert {(r.i, r.params["unexpected"]) for r in V.validate_one(rows, props, ["i"]).collect()} == {(1, "d"), (2, "b")}


def test_formats_are_parsed_once_on_all_cores(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    plan = optimized(QUERIES["orders_formats_checked"](spark, SMALL))
    assert plan.count("Repartition") == 2 and plan.lower().count("parsejson(") <= 4  # plain and commented JSON, the parsers' JSON, and null


@pytest.mark.parametrize("name", ["schema_properties_rows", "schema_descriptions"])
def test_tables_of_schemas_are_not_collected(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_needs_inside_of_properties_are_gathered(spark):
    node = {"anyOf": [{"type": "integer"}, {"properties": {"c": {"$ref": "#/$defs/n"}}}], "unevaluatedProperties": False}
    rows = spark.createDataFrame([(1, '{"c":{"c":{"c":{"c":{"c":{"c":{"c":{"c":{"d":1}}}}}}}}}'), (2, '{"c":{"c":{"c":{"c":{"c":{"c":{"c":{"c":7}}}}}}}}')], "i int, j string").select("i", F.parse_json("j").alias("instance"))
    found = V.validate_one(rows, {"$ref": "#/$defs/n", "$defs": {"n": node}}, ["i"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.i, r.instance_path, r.kind) for r in found.collect()} == {(1, "", "any_of"), (1, "", "unevaluated_properties")} and plan.lower().count("parsejson(") == 1


def test_trees_are_built_in_one_pass(spark, monkeypatch):
    from conform.operators import schemagraph as G

    written = []
    monkeypatch.setattr(G, "stored", lambda df, tag, put=G.stored: written.append(tag) or put(df, tag))
    rows = [("u", "", None, None, 0, "OBJECT", None), ("u", "/b", "", "b", 1, "ARRAY", None), ("u", "/b/0", "/b", "0", 0, "ARRAY", None), ("u", "/b/1", "/b", "1", 1, "OBJECT", None), ("u", "/a", "", 'q"é', 0, "BIGINT", "7"),
        ("u", "/enum", "", "enum", 2, "ARRAY", None), ("u", "/enum/0", "/enum", "0", 0, "BIGINT", "2"), ("u", "/enum/1", "/enum", "1", 1, "BIGINT", "1"), ("u", "/enum/2", "/enum", "2", 2, "BIGINT", "2"), ("u", "/lost/x", "/lost", "x", 0, "BIGINT", "1"), ("v", "", None, None, 0, "BOOLEAN", "true")]
    nodes = spark.createDataFrame(rows, "uri string, id string, parent string, key string, pos long, jtype string, text string")
    assert {r.uri: r.body for r in G.rebuild(nodes).collect()} == {"u": '{"q\\"é":7,"b":[[],{}],"enum":[2,1]}', "v": "true"} and written == ["tree"]
