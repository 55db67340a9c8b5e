"""The schema compiler against a plain recursive checker over mutated documents."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkspark.functions.json_schema import violations

COMMON = {"$id": "http://x/common.json", "$defs": {"Prob": {"type": "number", "minimum": 0, "maximum": 1}, "Ref": {"oneOf": [{"type": "string", "pattern": "^t[0-9]+$"}, {"type": "string", "pattern": "^s[0-9]+$"}]}, "Box": {"type": "array", "items": {"type": "number", "minimum": 0}, "minItems": 4, "maxItems": 4}}}
SCHEMA = {
    "type": "object", "required": ["id", "texts", "size"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 6, "pattern": "^[a-z0-9]+$"},
        "at": {"type": "string", "format": "date-time"},
        "size": {"$ref": "#/$defs/Size"},
        "status": {"enum": ["draft", "done", None]},
        "note": {"type": ["string", "null"]},
        "labels": {"type": "array", "uniqueItems": True, "items": {"type": "string"}},
        "texts": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["ref", "prob"], "properties": {"ref": {"$ref": "common.json#/$defs/Ref"}, "prob": {"$ref": "http://x/common.json#/$defs/Prob"}, "box": {"$ref": "common.json#/$defs/Box"}}}},
        "scores": {"type": "object", "additionalProperties": {"type": "integer", "exclusiveMinimum": 0}},
    },
    "if": {"properties": {"status": {"const": "done"}}, "required": ["status"]}, "then": {"required": ["at"]},
    "$defs": {"Size": {"type": "object", "required": ["w", "h"], "properties": {"w": {"type": "integer", "minimum": 1}, "h": {"type": "integer", "minimum": 1}}, "additionalProperties": False}},
}
GOOD = {"id": "ab1", "at": "2024-01-02T03:04:05Z", "size": {"w": 3, "h": 4.0}, "status": "done", "note": None, "labels": ["x", "y"], "texts": [{"ref": "t1", "prob": 0.5, "box": [0, 1, 2, 3]}, {"ref": "s2", "prob": 1}], "scores": {"a": 1}}


def plain(x, schema, path=()):
    """The rules once more, in plain Python."""
    if schema is True:
        return []
    if "$ref" in schema:
        ref = schema["$ref"]
        return plain(x, (COMMON if "common" in ref else SCHEMA)["$defs"][ref.rsplit("/", 1)[-1]], path)
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "number": number, "integer": number and x == int(x), "null": x is None, "boolean": isinstance(x, bool)}
    out, said = [], "/".join(map(str, path)) or "(top)"
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out += [] if any(kinds[k] for k in wanted) else [f"{said}: isn't {' or '.join(wanted)}"]
    if "enum" in schema and not any(type(x) is type(e) and x == e for e in schema["enum"]):
        out.append(f"{said}: isn't one of {', '.join('null' if e is None else str(e) for e in schema['enum'])}")
    if "const" in schema and x != schema["const"]:
        out.append(f"{said}: isn't {schema['const']}")
    if isinstance(x, str):
        out += [f"{said}: doesn't match {schema['pattern']}"] if "pattern" in schema and not re.search(schema["pattern"], x) else []
        out += [f"{said}: has fewer than {schema['minLength']} characters"] if len(x) < schema.get("minLength", 0) else []
        out += [f"{said}: has more than {schema['maxLength']} characters"] if len(x) > schema.get("maxLength", 99) else []
        out += [f"{said}: isn't a date and time"] if schema.get("format") and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", x) else []
    if number:
        out += [f"{said}: is less than {schema['minimum']}"] if "minimum" in schema and x < schema["minimum"] else []
        out += [f"{said}: is more than {schema['maximum']}"] if "maximum" in schema and x > schema["maximum"] else []
        out += [f"{said}: isn't more than {schema['exclusiveMinimum']}"] if "exclusiveMinimum" in schema and x <= schema["exclusiveMinimum"] else []
    if isinstance(x, list):
        out += [f"{said}: has fewer than {schema['minItems']} items"] if len(x) < schema.get("minItems", 0) else []
        out += [f"{said}: has more than {schema['maxItems']} items"] if len(x) > schema.get("maxItems", 99) else []
        out += [f"{said}: has repeated items"] if schema.get("uniqueItems") and len({json.dumps(i) for i in x}) < len(x) else []
        out += [e for i, v in enumerate(x) for e in plain(v, schema.get("items", True), (*path, i))]
    if isinstance(x, dict):
        out += [f"{said}: {r} is missing" for r in schema.get("required", []) if r not in x]
        for k, v in x.items():
            if k in schema.get("properties", {}):
                out += plain(v, schema["properties"][k], (*path, k))
            elif schema.get("additionalProperties") is False:
                out.append(f"{said}: {k} isn't allowed")
            elif "additionalProperties" in schema:
                out += plain(v, schema["additionalProperties"], (*path, k))
    if "oneOf" in schema:
        n = sum(not plain(x, s, path) for s in schema["oneOf"])
        out += [] if n == 1 else [f"{said}: fits {n} of {len(schema['oneOf'])} alternatives, not one"]
    if "if" in schema and not plain(x, schema["if"], path):
        out += plain(x, schema["then"], path)
    return out


def mutated(rng):
    doc = copy.deepcopy(GOOD)
    for _ in range(rng.randint(0, 3)):
        places = [(doc, k) for k in doc] + [(doc.get("size"), k) for k in (doc.get("size") if isinstance(doc.get("size"), dict) else ())] + [(t, k) for t in (doc.get("texts") if isinstance(doc.get("texts"), list) else ()) if isinstance(t, dict) for k in t]
        holder, key = rng.choice(places)
        if rng.random() < 0.3:
            holder.pop(key)
        elif rng.random() < 0.3:
            holder["extra"] = 1
        else:
            holder[key] = rng.choice([None, True, -1, 2.5, 0, "", "ab", "t9", "tooLong99", "done", [], [1], ["x", "x"], [1, 2, 3, 4, 5], {}, {"a": 0, "b": 1.5, "c": "x"}, [{"ref": "q", "prob": 2}]])
    return doc


def test_violations_equal_a_plain_checker(spark):
    rng = random.Random(4)
    docs = [GOOD, 5, [], "x", None, *(mutated(rng) for _ in range(300))]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    got = {r.i: sorted(r.v) for r in df.select("i", violations("doc", SCHEMA, {"common.json": COMMON}).alias("v")).collect()}
    assert got[0] == []
    for i, d in enumerate(docs):
        assert got[i] == sorted(plain(d, SCHEMA)), d


def test_broken_and_missing_texts(spark):
    df = spark.createDataFrame([("{",), (None,)], "doc string")
    assert [r.v for r in df.select(violations(F.col("doc"), {"type": "object"}).alias("v")).collect()] == [["(top): isn't JSON"], []]
    with pytest.raises(ValueError):
        violations("doc", {"$ref": "#/$defs/A", "$defs": {"A": {"properties": {"a": {"$ref": "#/$defs/A"}}}}})
