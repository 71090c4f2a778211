"""JSON schemas as native tests of variants. A schema is known when the query is built, so its rules unroll into one expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnseek.llm.common import let

#: How a JSON type shows in the schema of a parsed value. Integers are numbers without a fraction, however they are written.
_SHOWS = {"string": "STRING", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "null": "VOID"}
#: Keywords that say nothing about which values fit.
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}


def _shows(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^{_SHOWS[kind]}$")


def _number(value: Column) -> Column:
    """The value as a double, null if it isn't a number."""
    return F.when(_shows(value, "number"), F.try_variant_get(value, "$", "double"))


def _text(value: Column) -> Column:
    return F.when(_shows(value, "string"), F.try_variant_get(value, "$", "string"))


def _items(value: Column) -> Column:
    return F.when(_shows(value, "array"), F.try_variant_get(value, "$", "array<variant>"))


def _members(value: Column) -> Column:
    return F.when(_shows(value, "object"), F.try_variant_get(value, "$", "map<string,variant>"))


def _is(value: Column, kind: str) -> Column:
    if kind == "integer":
        written = F.to_json(value).rlike(r"^-?[0-9]+(\.0+)?$")
        return _shows(value, "number") & (written | F.coalesce(F.floor(_number(value)) == _number(value), F.lit(False)))
    if kind not in _SHOWS:
        raise ValueError(f"unknown JSON type {kind!r}")
    return _shows(value, kind)


def _equals(value: Column, wanted: object) -> Column:
    """The same JSON value; 1 and 1.0 are, "1" isn't."""
    if wanted is None:
        return _shows(value, "null")
    if isinstance(wanted, bool):
        return F.when(_shows(value, "boolean"), F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return _number(value) == float(wanted)
    if isinstance(wanted, str):
        return _text(value) == wanted
    if isinstance(wanted, dict):
        return fits({"type": "object", "properties": {k: {"const": v} for k, v in wanted.items()}, "required": list(wanted), "additionalProperties": False}, value)
    items = _items(value)
    same = [_equals(F.get(items, i), w) for i, w in enumerate(wanted)]
    return reduce(and_, same, F.size(items) == len(wanted))


def _properties(schema: dict, value: Column) -> Column:
    def check(members: Column) -> Column:
        rules = schema.get("properties", {})
        tests = [F.map_contains_key(members, name) for name in schema.get("required", [])]
        for name, rule in rules.items():
            tests.append(F.when(F.map_contains_key(members, name), fits(rule, F.try_element_at(members, F.lit(name)))).otherwise(F.lit(True)))
        others = schema.get("additionalProperties", True)
        known = F.array(*[F.lit(n) for n in rules]).cast("array<string>")
        if others is False:
            tests.append(F.size(F.array_except(F.map_keys(members), known)) == 0)
        elif isinstance(others, dict):
            tests.append(F.forall(F.map_entries(members), lambda e: F.array_contains(known, e["key"]) | fits(others, e["value"])))
        if "minProperties" in schema:
            tests.append(F.size(F.map_keys(members)) >= schema["minProperties"])
        if "maxProperties" in schema:
            tests.append(F.size(F.map_keys(members)) <= schema["maxProperties"])
        return reduce(and_, tests, F.lit(True))

    # Rules about members say nothing of other values.
    return F.when(_shows(value, "object"), let(_members(value), check)).otherwise(F.lit(True))


def _each(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(items, test)


#: What a keyword asks of a value: (kind of value, test of it and the keyword's own value).
_BOUNDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, object], Column]]] = {
    "minimum": (_number, lambda x, b: x >= float(b)),
    "maximum": (_number, lambda x, b: x <= float(b)),
    "exclusiveMinimum": (_number, lambda x, b: x > float(b)),
    "exclusiveMaximum": (_number, lambda x, b: x < float(b)),
    "multipleOf": (_number, lambda x, b: x / float(b) == F.floor(x / float(b))),
    "minLength": (_text, lambda x, b: F.char_length(x) >= b),
    "maxLength": (_text, lambda x, b: F.char_length(x) <= b),
    "pattern": (_text, lambda x, b: x.rlike(b)),
    "minItems": (_items, lambda x, b: F.size(x) >= b),
    "maxItems": (_items, lambda x, b: F.size(x) <= b),
    "uniqueItems": (_items, lambda x, b: F.size(F.array_distinct(F.transform(x, lambda i: F.to_json(i)))) == F.size(x) if b else F.lit(True)),
    "items": (_items, lambda x, b: _each(x, lambda i: fits(b, i))),
}
_OF_MEMBERS = {"properties", "required", "additionalProperties", "minProperties", "maxProperties"}


def fits(schema: dict | bool, value: Column) -> Column:
    """Whether a parsed JSON value fits a schema; never null.

    Keywords: type (one or a list), enum, const, bounds, lengths, pattern (a Java expression, found anywhere), items, uniqueItems,
    properties, required, additionalProperties, allOf, anyOf, oneOf, not. Others, but for mere notes, raise ValueError when the
    query is built. Numbers are compared as doubles.
    """
    if isinstance(schema, bool):
        return F.lit(schema)
    unknown = set(schema) - _NOTES - _OF_MEMBERS - set(_BOUNDS) - {"type", "enum", "const", "allOf", "anyOf", "oneOf", "not"}
    if unknown:
        raise ValueError(f"schema keywords {sorted(unknown)} aren't supported")

    def check(v: Column) -> Column:
        tests = []
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            tests.append(reduce(or_, [_is(v, k) for k in kinds]))
        if "const" in schema:
            tests.append(_equals(v, schema["const"]))
        if "enum" in schema:
            tests.append(reduce(or_, [F.coalesce(_equals(v, w), F.lit(False)) for w in schema["enum"]], F.lit(False)))
        for word, (read, test) in _BOUNDS.items():
            if word in schema:
                part = read(v)
                tests.append(part.isNull() | test(part, schema[word]))
        if _OF_MEMBERS & set(schema):
            tests.append(_properties(schema, v))
        for word, how in (("allOf", and_), ("anyOf", or_)):
            if word in schema:
                tests.append(reduce(how, [fits(s, v) for s in schema[word]]))
        if "oneOf" in schema:
            tests.append(sum(fits(s, v).cast("int") for s in schema["oneOf"]) == 1)
        if "not" in schema:
            tests.append(~fits(schema["not"], v))
        return F.coalesce(reduce(and_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True)), F.lit(False))

    return F.coalesce(let(value, check), F.lit(False))
