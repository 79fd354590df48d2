"""Types of OpenAPI schemas in words."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.sources.specs import _type


def nested(levels, inner):
    return inner if not levels else {"type": "array", "items": nested(levels - 1, inner)}


@pytest.mark.parametrize(
    "schema,want",
    [
        ({"type": "string"}, "string"),
        ({"type": "integer", "format": "int64"}, "integer (int64)"),
        ({"type": "string", "enum": ["a", "b"]}, "string (enum: a, b)"),
        ({"$ref": "#/components/schemas/Pet"}, "Pet"),
        (nested(1, {"$ref": "#/x/Pet"}), "array of Pet"),
        (nested(9, {"type": "string", "format": "date"}), "array of " * 9 + "string (date)"),
        ({"type": "array"}, "array of "),
        ({"type": "object", "properties": {"items": {"type": "array"}}}, "object"),
        ({}, ""),
    ],
)
def test_types(spark, schema, want):
    assert spark.createDataFrame([(json.dumps(schema),)], "s string").select(_type(F.col("s"))).first()[0] == want
