"""Leaf operators as Column predicates. All are built-ins, so filters reach the scan and stay in generated code."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value: object, kind: T.DataType | None = None) -> Column:
    """A literal for comparison with a column of the given type: text that stands for a time or number is converted."""
    if isinstance(value, dt.datetime) and value.tzinfo is not None and isinstance(kind, T.TimestampNTZType):
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if kind is not None and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value).cast(kind)
    if kind is not None and isinstance(kind, T.DecimalType):
        return F.lit(str(value)).cast(kind)
    return F.lit(value)


def text_match(c: Column, op: str, value: str, insensitive: bool) -> Column:
    """like: contains; startsWith; endsWith. Wildcards mean themselves."""
    v = F.lit(value)
    if insensitive:
        c, v = F.lower(c), F.lower(v)
    return {"like": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](c, v)


def equals(c: Column, value: object, kind: T.DataType | None, insensitive: bool) -> Column:
    if value is None:
        return c.isNull()
    if insensitive and isinstance(value, str):
        return F.lower(c) == F.lower(F.lit(value))
    return c == literal(value, kind)


def within(c: Column, ops: Mapping[str, object], kind: T.DataType | None) -> Column:
    out = None
    for op in ("gte", "lte"):
        if op in ops:
            v = literal(ops[op], kind)
            p = c >= v if op == "gte" else c <= v
            out = p if out is None else out & p
    return out


def values_array(values: Iterable[object], kind: T.DataType | None) -> Column:
    element = kind.elementType if isinstance(kind, T.ArrayType) else None
    a = F.array(*[literal(v, element) for v in values])
    return a.cast(T.ArrayType(element)) if element is not None else a


def has_some(c: Column, values: Iterable[object], kind: T.DataType | None) -> Column:
    """Shares a value; null elements don't matter, and a null list gives null."""
    return F.when(c.isNotNull(), F.coalesce(F.arrays_overlap(c, values_array(values, kind)), F.lit(False)))


def has_every(c: Column, values: Iterable[object], kind: T.DataType | None) -> Column:
    return F.size(F.array_except(values_array(values, kind), c)) == 0 if kind is None else F.when(c.isNotNull(), F.size(F.array_except(values_array(values, kind), c)) == 0)


def json_path(segments: Iterable[str]) -> str:
    """$.a[0]['b c'] for segments a, 0 and ``b c``."""
    out = "$"
    for s in segments:
        out += f"[{s}]" if s.isdigit() else f".{s}" if s.replace("_", "a").isalnum() else f"['{s}']"
    return out


def json_match(c: Column, segments: list[str], ops: Mapping[str, object], insensitive: bool) -> Column | None:
    """A condition on a value inside JSON text, by JSON's own types: "10" isn't 10. None for operators that JSON has not.

    The text is parsed once for a condition, however often the condition looks at it.
    """
    path = json_path(segments)
    (op, value), *_ = ops.items()
    if op not in ("equals", "like", "startsWith", "endsWith", "hasEvery", "gte", "lte") or op == "equals" and not isinstance(value, (type(None), bool, int, float, str)):
        return None

    def test(doc: Column) -> Column:
        found = F.try_variant_get(doc, path, "variant")
        if op == "hasEvery":
            items = F.try_variant_get(doc, path, "array<variant>")
            return reduce(operator.and_, [_json_holds(items, v) for v in value])
        if op == "equals":
            return _json_equals(found, value)
        if op in ("like", "startsWith", "endsWith"):
            return text_match(_json_text(found), op, value, insensitive)
        if all(isinstance(x, (int, float)) for x in ops.values()):
            return within(_json_number(found), ops, None)
        return within(_json_text(found), {k: str(x) for k, x in ops.items()}, None)

    return F.exists(F.array(F.try_parse_json(c)), test)


def _json_holds(items: Column, value: object) -> Column:
    return F.exists(items, lambda x: F.coalesce(_json_equals(x, value), F.lit(False)))


def _json_text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _json_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _json_equals(v: Column, value: object) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(value, bool):
        return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")) == F.lit(value)
    if isinstance(value, (int, float)):
        return _json_number(v) == F.lit(float(value))
    return _json_text(v) == F.lit(str(value))
