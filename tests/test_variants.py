"""Schemas and searches over JSON of any shape."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import variants

SCHEMA = {
    "type": "object",
    "required": ["a", "b"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 3},
        "b": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 2, "pattern": "^x"}},
        "c": {"type": ["string", "null"], "enum": ["u", None]},
        "d": {"type": "object", "required": ["e"], "properties": {"e": {"type": "number", "exclusiveMaximum": 1.5}}},
    },
}
FAULTS = {
    '{"a":3,"b":[]}': [],
    '{"a":2.0,"b":["x","yyy",1]}': ["$.a minimum", "$.b maxItems", "$.b[1] maxLength", "$.b[1] pattern", "$.b[2] type"],
    '{"b":"q","c":"v","z":1,"y":2}': ["$.a required", "$.b type", "$.c enum", "$.y additionalProperties", "$.z additionalProperties"],
    '{"a":1.5,"b":null,"c":null,"d":{"e":1.5}}': ["$.a minimum", "$.a type", "$.b type", "$.d.e exclusiveMaximum"],
    "[1]": ["$ type"],
    "nope": ["$ json"],
    None: [],
    '{"a":4,"b":["xx"],"d":{}}': ["$.d.e required"],
    '{"a":null,"b":[null]}': ["$.a type", "$.b[0] type"],
}


def faults(spark, rows, schema):
    found = variants.faults(spark.createDataFrame(list(enumerate(rows)), "id int, p string"), "p", schema).collect()
    return [sorted(f"{r['path']} {r['rule']}" for r in found if r["id"] == k) for k in range(len(rows))]


def test_faults(spark):
    assert faults(spark, list(FAULTS), SCHEMA) == list(FAULTS.values())
    others = {"additionalProperties": {"type": "boolean"}, "properties": {"a": {}}}
    assert faults(spark, ['{"a":1,"b":true,"c":0}', "7"], others) == [["$.c type"], []]
    assert faults(spark, ["1", "1.0", '"1"', "2", "[]", "[1]", '"abc"'], {"const": 1}) [0] == []
    assert faults(spark, ["[]", "[1]", '""', '"a"', "{}"], {"minItems": 1, "minLength": 1}) == [["$ minItems"], [], ["$ minLength"], [], []]
    with pytest.raises(ValueError):
        variants.violations(F.lit(None), {"oneOf": []})


def test_objects_at_any_depth(spark):
    rows = ['{"@graph":[{"x":{"y":{"@type":"J","t":1}}},{"@type":["A","J"]}],"@type":"J"}', '[[[{"@type":"J"}]]]', "x", '{"@type":"O"}', None, '{"@type":{"@type":"J"}}', "[]"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, p string")
    got = sorted((r["id"], r["path"]) for r in variants.typed_objects(df, "p", ["J", "K"]).collect())
    assert got == [(0, "$"), (0, "$.@graph[0].x.y"), (0, "$.@graph[1]"), (1, "$[0][0][0]"), (5, "$.@type")]
    assert variants.typed_objects(df.limit(0), "p", ["J"]).count() == 0
    with pytest.raises(ValueError):
        variants.typed_objects(df, "p", ["J"], most_depth=2)
    plan = variants.typed_objects(df, "p", ["J"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
