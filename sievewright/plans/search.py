"""Search trees: a boolean AST, and a parser that accepts any JSON and keeps what is meaningful."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

#: By which operator a condition goes when it has several; range operators come last and together.
PRECEDENCE = ("isNull", "equals", "like", "startsWith", "endsWith", "in", "notIn", "hasSome", "hasEvery")
RANGE = ("between", "gte", "lte")
QUANTIFIERS = ("some", "every", "none")


@dataclass(frozen=True)
class Condition:
    field: str
    ops: Mapping[str, object] = field(default_factory=dict)
    or_null: bool = False
    insensitive: bool | None = None
    relation: str = "some"


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    child: Node


Node = Condition | And | Or | Not


def is_valid_value(value: object) -> bool:
    """Whether a filter value says anything: not None, blank, empty, or a mapping with any such member."""
    if value is None:
        return False
    if isinstance(value, str):
        return bool(value.strip())
    if isinstance(value, Mapping):
        return bool(value) and all(is_valid_value(v) for v in value.values())
    if isinstance(value, (list, tuple, set, frozenset)):
        return len(value) > 0
    return True


def parse(tree: object) -> Node | None:
    """The AST of a tree of mappings and lists, a list at the root being ``and``. Anything that makes no sense is left out."""
    if isinstance(tree, (Condition, And, Or, Not)):
        return tree
    if isinstance(tree, (list, tuple)):
        return _group(And, tree)
    if not isinstance(tree, Mapping):
        return None
    if isinstance(tree.get("field"), str):
        return _condition(tree)
    for name, kind in (("and", And), ("or", Or)):
        if name in tree:
            return _group(kind, tree[name]) if isinstance(tree[name], (list, tuple)) else None
    if isinstance(tree.get("not"), Mapping) or isinstance(tree.get("not"), (Condition, And, Or, Not)):
        inner = parse(tree["not"])
        return None if inner is None else Not(inner)
    return None


def _group(kind: type, children: Iterable[object]) -> Node | None:
    kept = [n for n in (parse(c) for c in children if not isinstance(c, (list, tuple))) if n is not None]
    if not kept:
        return None
    return kept[0] if len(kept) == 1 else kind(tuple(kept))


def _condition(tree: Mapping) -> Condition | None:
    path = tree["field"].strip()
    if not path:
        return None
    ops = effective(tree)
    if not ops:
        return None
    flag = tree.get("insensitive")
    quantifier = tree.get("relation")
    return Condition(path, ops, tree.get("orNull") is True, flag if isinstance(flag, bool) else None, quantifier if quantifier in QUANTIFIERS else "some")


def effective(tree: Mapping) -> dict[str, object]:
    """The one operator that counts, with its value, or the range; {} where that is invalid, even if another one isn't."""
    for op in PRECEDENCE:
        if op not in tree:
            continue
        value = tree[op]
        if op == "isNull":
            return {"isNull": True} if value is True else {}
        if op == "equals":
            return {"equals": value} if value is None or is_valid_value(value) else {}
        if op in ("like", "startsWith", "endsWith"):
            return {op: value} if isinstance(value, str) and value.strip() else {}
        values = [v for v in value if v is not None] if isinstance(value, (list, tuple, set, frozenset)) else []
        return {op: values} if values else {}
    low, high = tree.get("gte"), tree.get("lte")
    if "between" in tree:
        pair = tree["between"]
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            return {}
        low, high = pair
    out = {}
    if is_valid_value(low):
        out["gte"] = low
    if is_valid_value(high):
        out["lte"] = high
    return out


def _each(fields: Iterable[str], rule: Mapping[str, object]) -> list[dict[str, object]]:
    return [{"field": f, **rule} for f in fields]


def any_of(fields: Iterable[str], rule: Mapping[str, object]) -> dict[str, object]:
    """The rule for any of the fields."""
    each = _each(fields, rule)
    return each[0] if len(each) == 1 else {"or": each}


def all_of(fields: Iterable[str], rule: Mapping[str, object]) -> dict[str, object]:
    """The rule for all of the fields."""
    each = _each(fields, rule)
    return each[0] if len(each) == 1 else {"and": each}


def conditions_from(values: Mapping[str, object], op: str = "equals") -> list[dict[str, object]]:
    """A condition for each non-blank text among the values."""
    return [{"field": k, op: v} for k, v in values.items() if isinstance(v, str) and v.strip()]


def temporal(value: object) -> bool:
    return isinstance(value, (dt.date, dt.datetime))
