"""Whether a value changed: strictly, or after normalisation."""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 2.0**-52


def differs(old: Column, new: Column, kind: T.DataType, mode: str = "strict") -> Column:
    """True or false, never null. ``strict`` is IS DISTINCT FROM; ``normalized`` trims text, takes blank for null and lets
    floats differ by an ulp relative to the larger of them and 1, also inside arrays, in order, and structs."""
    if mode not in ("strict", "normalized"):
        raise ValueError(f"no such comparison: {mode}")
    if mode == "normalized":
        if isinstance(kind, T.StringType):
            old, new = F.nullif(F.trim(old), F.lit("")), F.nullif(F.trim(new), F.lit(""))
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            a, b = old.cast("double"), new.cast("double")
            close = F.abs(a - b) <= F.lit(EPSILON) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
            return ~(old.eqNullSafe(new) | F.coalesce(close, F.lit(False)))
        elif isinstance(kind, T.ArrayType):
            unequal = F.exists(F.zip_with(old, new, lambda x, y: differs(x, y, kind.elementType, mode)), lambda x: x)
            return _both(old, new, (F.size(old) != F.size(new)) | unequal)
        elif isinstance(kind, T.StructType):
            parts = [differs(old[f.name], new[f.name], f.dataType, mode) for f in kind.fields]
            return _both(old, new, reduce(operator.or_, parts, F.lit(False)))
    if isinstance(kind, T.MapType):
        old, new = F.array_sort(F.map_entries(old)), F.array_sort(F.map_entries(new))
    return ~old.eqNullSafe(new)


def _both(old: Column, new: Column, unequal: Column) -> Column:
    return F.when(old.isNull() | new.isNull(), ~(old.isNull() & new.isNull())).otherwise(F.coalesce(unequal, F.lit(False)))


def normalize_value(value: object) -> object:
    """The same normalisation for Python values."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, Decimal):
        return float(value)
    return value


def numbers_equal(a: float, b: float) -> bool:
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= EPSILON * max(1.0, abs(a), abs(b))


def deep_equal(a: object, b: object) -> bool:
    """Normalised equality through lists, where order counts, and mappings, where it doesn't."""
    a, b = normalize_value(a), normalize_value(b)
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return numbers_equal(a, b)
    if isinstance(a, (datetime, date)) or isinstance(b, (datetime, date)):
        return type(a) is type(b) and a == b
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return a.keys() == b.keys() and all(deep_equal(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    return a == b


IGNORED = ("id", "createdAt", "updatedAt")


def has_changes(new: Mapping[str, object], old: Mapping[str, object], ignore: tuple[str, ...] = IGNORED) -> bool:
    """Whether a field of ``new``, other than the ignored ones, differs from ``old``'s."""
    return any(k not in ignore and not deep_equal(v, old.get(k)) for k, v in new.items())
