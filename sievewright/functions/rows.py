"""Row shapes on the driver: nested paths, cleaned keys, payloads, and the greedy choice of rows among overlapping keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date, datetime


def assign(into: dict, path: str, value: object) -> dict:
    """Sets a dotted path, making mappings on the way."""
    *parents, last = path.split(".")
    at = into
    for p in parents:
        nxt = at.get(p)
        if not isinstance(nxt, dict):
            nxt = at[p] = {}
        at = nxt
    at[last] = value
    return into


def build(path: str, value: object) -> dict:
    return assign({}, path, value)


def get(tree: object, path: str, default: object = None) -> object:
    for p in path.split("."):
        if isinstance(tree, Mapping) and p in tree:
            tree = tree[p]
        elif isinstance(tree, Sequence) and not isinstance(tree, str) and p.isdigit() and int(p) < len(tree):
            tree = tree[int(p)]
        else:
            return default
    return tree


def clean(tree: object) -> object:
    """Without None members, and without mappings that this leaves empty."""
    if isinstance(tree, Mapping):
        kept = {k: clean(v) for k, v in tree.items() if v is not None}
        return {k: v for k, v in kept.items() if v != {}}
    return [clean(x) for x in tree] if isinstance(tree, list) else tree


def sanitize_keys(tree: object) -> object:
    """Keys without leading underscores, all the way down."""
    if isinstance(tree, Mapping):
        return {k.lstrip("_"): sanitize_keys(v) for k, v in tree.items()}
    return [sanitize_keys(x) for x in tree] if isinstance(tree, list) else tree


def first_by_keys(items: Iterable[Mapping[str, object]], constraints: Sequence[Sequence[str]]) -> list[Mapping[str, object]]:
    """Items in order, each unless a kept one has the same complete key under some constraint."""
    seen: list[set] = [set() for _ in constraints]
    out = []
    for item in items:
        keys = [tuple(item.get(f) for f in c) for c in constraints]
        full = [k if all(v is not None for v in k) else None for k in keys]
        if any(k is not None and k in s for k, s in zip(full, seen)):
            continue
        for k, s in zip(full, seen):
            if k is not None:
                s.add(k)
        out.append(item)
    return out


RELATION_OPERATIONS = frozenset({"connect", "create", "connectOrCreate", "disconnect", "delete", "deleteMany", "set", "update", "updateMany", "upsert"})


def has_relation_operations(value: object) -> bool:
    return isinstance(value, Mapping) and bool(RELATION_OPERATIONS & value.keys())


def foreign_keys(item: Mapping[str, object], name: Callable[[str], str] = lambda relation: f"{relation}Id") -> dict[str, object]:
    """Relation objects as key columns: {"author": {"id": 3}} and {"author": {"connect": {"id": 3}}} give authorId 3, or as ``name`` says; an explicit key wins."""
    out: dict[str, object] = {}
    for k, v in item.items():
        ref = v.get("connect", v) if isinstance(v, Mapping) else None
        if isinstance(ref, Mapping) and set(ref) == {"id"}:
            out.setdefault(name(k), ref["id"])
        else:
            out[k] = v
    return {**out, **{k: item[k] for k in item if k in out and not isinstance(item[k], Mapping)}}


def update_payload(item: Mapping[str, object], created_at: str = "createdAt") -> dict[str, object]:
    """What an update may write: not createdAt, empty mappings or relation operations. None means null."""
    return {k: v for k, v in item.items() if k != created_at and v != {} and not has_relation_operations(v)}


def is_plain_object(value: object) -> bool:
    return isinstance(value, Mapping) and not isinstance(value, (date, datetime))


def is_empty(value: object) -> bool:
    return value is None or (isinstance(value, (str, Mapping, list, tuple, set)) and len(value) == 0)


def is_non_empty_list(value: object) -> bool:
    return isinstance(value, (list, tuple)) and len(value) > 0


def unique_by_id(rows: Iterable[Mapping[str, object]], key: str = "id") -> list[Mapping[str, object]]:
    """The first row of each id; rows without one all stay."""
    seen, out = set(), []
    for r in rows:
        k = r.get(key)
        if k is None or k not in seen:
            out.append(r)
            seen.add(k)
    return out
