"""JSON Schema compiled to column expressions over VARIANT values: every violation of a document as ``path: message``.

A schema is a Python dict; ``$ref`` points into its own ``$defs`` or, by the name of a file or an ``$id``, into other schemas. Known keywords: type, enum,
const, required, properties, additionalProperties, items, minItems, maxItems, uniqueItems, contains, pattern, format (date-time), minLength, maxLength,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf, anyOf, oneOf, not, if/then/else. Others are ignored, as annotations are. Schemas that
contain themselves can't be compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspark.functions.text import bound

TOP = "(top)"
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def _none() -> Column:
    return F.array().cast("array<string>")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


class _Compiler:
    def __init__(self, schema: dict, others: dict[str, dict]) -> None:
        self.root, self.others = schema, others

    def resolve(self, ref: str, root: dict) -> tuple[dict, dict]:
        """(the schema that a reference names, the document that it is in)."""
        name, _, pointer = ref.partition("#")
        if name:
            root = next(s for key, s in self.others.items() if name in (key, s.get("$id")) or name.rsplit("/", 1)[-1] == key)
        parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
        return reduce(lambda node, p: node[p], parts, root), root

    def errors(self, v: Column, path: Column, schema: dict | bool, root: dict, seen: tuple[str, ...] = ()) -> Column:
        """array<string> of the violations of ``v``; ``v`` is present."""
        if schema is True or schema == {}:
            return _none()
        said = F.when(path == "", F.lit(TOP)).otherwise(path)
        if schema is False:
            return F.array(F.concat(said, F.lit(": isn't allowed")))
        return bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"), path.alias("path"), said.alias("said")), lambda at: self._checks(at, schema, root, seen))

    def _checks(self, at: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
        v, kind = at.v, at.kind
        say = lambda broken, message: F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(at.said, F.lit(": "), message if isinstance(message, Column) else F.lit(message)))).otherwise(_none())
        is_object, is_array, is_text = kind.startswith("OBJECT"), kind.startswith("ARRAY"), kind == "STRING"
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        tests = {"object": is_object, "array": is_array, "string": is_text, "number": is_number, "boolean": kind == "BOOLEAN", "null": kind == "VOID", "integer": is_number & (number == F.floor(number))}
        found = []
        if "$ref" in schema:
            ref = schema["$ref"]
            if (ref, id(root)) in seen:
                raise ValueError(f"{ref} contains itself")
            target, home = self.resolve(ref, root)
            found.append(self.errors(v, at.path, target, home, (*seen, (ref, id(root)))))
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            found.append(say(~reduce(lambda a, b: a | b, [tests[k] for k in kinds]), f"isn't {' or '.join(kinds)}"))
        for key, options in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if options is not None:
                same = [self._equals(o, tests, text, number, v) for o in options]
                names = ", ".join("null" if o is None else str(o) for o in options)
                found.append(say(~reduce(lambda a, b: a | b, same, F.lit(False)), f"isn't {'one of ' if key == 'enum' else ''}{names}"))
        for key, broken, message in (
            ("pattern", lambda p: is_text & ~text.rlike(p), "doesn't match {}"), ("minLength", lambda n: is_text & (F.char_length(text) < n), "has fewer than {} characters"), ("maxLength", lambda n: is_text & (F.char_length(text) > n), "has more than {} characters"),
            ("minimum", lambda n: is_number & (number < n), "is less than {}"), ("maximum", lambda n: is_number & (number > n), "is more than {}"),
            ("exclusiveMinimum", lambda n: is_number & (number <= n), "isn't more than {}"), ("exclusiveMaximum", lambda n: is_number & (number >= n), "isn't less than {}"),
        ):
            if key in schema:
                found.append(say(broken(schema[key]), message.format(schema[key])))
        if schema.get("format") == "date-time":
            found.append(say(is_text & ~(text.rlike(DATE_TIME) & F.try_to_timestamp(text).isNotNull()), "isn't a date and time"))
        if {"items", "minItems", "maxItems", "uniqueItems", "contains"} & schema.keys():
            items = F.try_variant_get(v, "$", "array<variant>")
            found.append(F.when(is_array, bound(items, lambda a: self._items(a, at, schema, root, seen, say))).otherwise(_none()))
        if {"required", "properties", "additionalProperties"} & schema.keys():
            fields = F.try_variant_get(v, "$", "map<string,variant>")
            found.append(F.when(is_object, bound(fields, lambda m: self._fields(m, at, schema, root, seen, say))).otherwise(_none()))
        inner = lambda s: self.errors(v, at.path, s, root, seen)
        found += [inner(s) for s in schema.get("allOf", [])]
        fits = lambda options: reduce(lambda a, b: a + b, [(F.size(inner(s)) == 0).cast("int") for s in options])
        if "anyOf" in schema:
            found.append(say(fits(schema["anyOf"]) == 0, f"fits none of {len(schema['anyOf'])} alternatives"))
        if "oneOf" in schema:
            found.append(bound(fits(schema["oneOf"]), lambda n: say(n != 1, F.concat(F.lit("fits "), n.cast("string"), F.lit(f" of {len(schema['oneOf'])} alternatives, not one")))))
        if "not" in schema:
            found.append(say(F.size(inner(schema["not"])) == 0, "fits what it must not"))
        if "if" in schema:
            found.append(F.when(F.size(inner(schema["if"])) == 0, inner(schema.get("then", True))).otherwise(inner(schema.get("else", True))))
        return _joined(found)

    def _present(self, path: Column, rule: dict, root: dict, seen: tuple[str, ...], x: Column) -> Column:
        return F.when(x.isNotNull(), self.errors(x, path, rule, root, seen)).otherwise(_none())

    def _equals(self, option, tests: dict[str, Column], text: Column, number: Column, v: Column) -> Column:
        """Whether the value is a plain JSON value."""
        if option is None:
            return tests["null"]
        if isinstance(option, bool):
            return tests["boolean"] & (F.try_variant_get(v, "$", "boolean") == option)
        return tests["string"] & (text == option) if isinstance(option, str) else tests["number"] & (number == option)

    def _items(self, a: Column, at: Column, schema: dict, root: dict, seen: tuple[str, ...], say: Callable) -> Column:
        found = []
        if "minItems" in schema:
            found.append(say(F.size(a) < schema["minItems"], f"has fewer than {schema['minItems']} items"))
        if "maxItems" in schema:
            found.append(say(F.size(a) > schema["maxItems"], f"has more than {schema['maxItems']} items"))
        if schema.get("uniqueItems"):
            texts = F.transform(a, lambda x: F.to_json(x))
            found.append(say(F.size(F.array_distinct(texts)) < F.size(texts), "has repeated items"))
        if "contains" in schema:
            found.append(say(~F.exists(a, lambda x: F.size(self.errors(x, F.lit(""), schema["contains"], root, seen)) == 0), "has no item that fits"))
        if "items" in schema:
            place = lambda i: F.concat(at.path, F.when(at.path == "", "").otherwise("/"), i.cast("string"))
            found.append(F.flatten(F.transform(a, lambda x, i: self.errors(x, place(i), schema["items"], root, seen))))
        return _joined(found)

    def _fields(self, m: Column, at: Column, schema: dict, root: dict, seen: tuple[str, ...], say: Callable) -> Column:
        below = lambda name: F.concat(at.path, F.when(at.path == "", "").otherwise("/"), name if isinstance(name, Column) else F.lit(name))
        found = [say(~F.map_contains_key(m, name), f"{name} is missing") for name in schema.get("required", [])]
        known = schema.get("properties", {})
        for name, rule in known.items():
            if rule is True or rule == {}:
                continue
            found.append(bound(F.try_element_at(m, F.lit(name)), partial(self._present, below(name), rule, root, seen)))
        more = schema.get("additionalProperties", True)
        if more is not True and more != {}:
            rest = F.filter(F.map_keys(m), lambda k: ~k.isin(*known)) if known else F.map_keys(m)
            if more is False:
                found.append(F.transform(F.array_sort(rest), lambda k: F.concat(at.said, F.lit(": "), k, F.lit(" isn't allowed"))))
            else:
                found.append(F.flatten(F.transform(F.array_sort(rest), lambda k: self.errors(F.try_element_at(m, k), below(k), more, root, seen))))
        return _joined(found)


def violations(document: Column | str, schema: dict, others: dict[str, dict] | None = None) -> Column:
    """array<string>: every violation of a JSON text, in the schema's order; a text that isn't JSON has one, null has none."""
    text = F.col(document) if isinstance(document, str) else document
    checks = _Compiler(schema, others or {})
    broken = F.when(text.isNull(), _none()).otherwise(F.array(F.lit(f"{TOP}: isn't JSON")))
    return bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), broken).otherwise(checks.errors(v, F.lit(""), schema, schema)))
