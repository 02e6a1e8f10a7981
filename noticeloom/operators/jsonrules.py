"""JSON Schema as Columns: a schema is compiled once into one expression over a column of JSON, and each row gets its errors.

Keywords: type, const, enum, pattern, minimum, maximum, minLength, maxLength, format (date-time), required, properties, additionalProperties (false),
items, minItems, maxItems.  Others are ignored, as validators ignore what they do not know; references are not followed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<depth: int, path: string, rule: string>"
#: How Spark names the type of a JSON value, by the names of a schema.
_TYPES = {"string": "STRING", "null": "VOID", "boolean": "BOOLEAN", "object": "OBJECT<", "array": "ARRAY<"}
_WHOLE, _REAL = ("BIGINT",), ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def _is(kind: Column, value: Column, name: str) -> Column:
    if name == "number":
        return reduce(lambda a, b: a | b, [kind.startswith(k) for k in _REAL])
    if name == "integer":  # 4.0 is an integer to a schema
        number = F.try_variant_get(value, "$", "double")
        return kind.isin(*_WHOLE) | _is(kind, value, "number") & F.coalesce(number == F.floor(number), F.lit(False))
    return kind.startswith(_TYPES[name])


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _error(broken: Column, depth: int, path: Column, rule: str) -> Column:
    found = F.array(F.struct(F.lit(depth).alias("depth"), path.alias("path"), F.lit(rule).alias("rule")).cast(ERROR))
    return F.when(F.coalesce(broken, F.lit(False)), found).otherwise(_none())


def _equal(value: Column, kind: Column, wanted) -> Column:
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, int | float):
        return _is(kind, value, "number") & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))


def _compiled(schema: dict, value: Column, path: Column, depth: int) -> Column:
    """Errors of a value that is there, in the order of the schema's keywords."""
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "STRING", _is(kind, value, "number")
    is_object, is_array = kind.startswith("OBJECT<"), kind.startswith("ARRAY<")
    parts: list[Column] = []
    fail = lambda broken, rule: parts.append(_error(broken, depth, path, rule))
    for rule, wanted in schema.items():
        if rule == "type":
            names = wanted if isinstance(wanted, list) else [wanted]
            fail(~reduce(lambda a, b: a | b, [_is(kind, value, n) for n in names]), "type")
        elif rule == "const":
            fail(~F.coalesce(_equal(value, kind, wanted), F.lit(False)), "const")
        elif rule == "enum":
            fail(~F.coalesce(reduce(lambda a, b: a | b, [_equal(value, kind, w) for w in wanted]), F.lit(False)), "enum")
        elif rule == "pattern":
            fail(is_text & ~text.rlike(wanted), rule)
        elif rule in ("minimum", "maximum"):
            fail(is_number & (number < wanted if rule == "minimum" else number > wanted), rule)
        elif rule in ("minLength", "maxLength"):
            fail(is_text & (F.length(text) < wanted if rule == "minLength" else F.length(text) > wanted), rule)
        elif rule == "format" and wanted == "date-time":
            fail(is_text & (~text.rlike(r"(?i)^\d{4}-\d\d-\d\d[t ]\d\d:\d\d:\d\d(?:\.\d+)?(?:z|[+-]\d\d:\d\d)$") | text.try_cast("timestamp").isNull()), rule)
        elif rule in ("required", "properties", "additionalProperties") and wanted is not True:
            members = F.try_variant_get(value, "$", "map<string,variant>")
            if rule == "required":
                missing = F.filter(F.array(*[F.lit(n) for n in wanted]), lambda n: ~F.map_contains_key(members, n))
                parts.append(F.when(is_object, F.transform(missing, lambda n: F.struct(F.lit(depth).alias("depth"), F.concat(path, F.lit("."), n).alias("path"), F.lit("required").alias("rule")).cast(ERROR))).otherwise(_none()))
            elif rule == "properties":
                for name, inner in wanted.items():
                    child = F.element_at(members, F.lit(name))
                    found = _compiled(inner, child, F.concat(path, F.lit(f".{name}")), depth + 1)
                    parts.append(F.when(is_object & F.map_contains_key(members, F.lit(name)), found).otherwise(_none()))
            else:
                known = list(schema.get("properties", {}))
                more = F.filter(F.map_keys(members), lambda n: ~n.isin(known))
                parts.append(F.when(is_object, F.transform(more, lambda n: F.struct(F.lit(depth).alias("depth"), F.concat(path, F.lit("."), n).alias("path"), F.lit("additionalProperties").alias("rule")).cast(ERROR))).otherwise(_none()))
        elif rule == "items":
            rows = F.try_variant_get(value, "$", "array<variant>")
            parts.append(F.when(is_array, F.flatten(F.transform(rows, _of_item(wanted, path, depth)))).otherwise(_none()))
        elif rule in ("minItems", "maxItems"):
            size = F.size(F.try_variant_get(value, "$", "array<variant>"))
            fail(is_array & (size < wanted if rule == "minItems" else size > wanted), rule)
    return F.concat(*parts) if parts else _none()


def _of_item(schema: dict, path: Column, depth: int):
    return lambda x, i: _compiled(schema, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)


def errors(json: Column, schema: dict) -> Column:
    """``array<struct<depth, path, rule>>`` of a JSON text; what is no JSON has the one error ``json``.  Paths begin with ``$``."""
    value = F.try_parse_json(json)
    broken = F.array(F.struct(F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit("json").alias("rule")).cast(ERROR))
    return F.when(value.isNull(), broken).otherwise(_compiled(schema, value, F.lit("$"), 0))


def best(found: Column) -> Column:
    """The error to show: the shallowest, of these the first in the order of the schema; null without any."""
    least = F.array_min(F.transform(found, lambda e: e["depth"]))
    return F.get(F.filter(found, lambda e: e["depth"] == least), F.lit(0))
