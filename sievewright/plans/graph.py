"""The graph of models: dependency order, paths between models, and trees of relations to include."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from graphlib import CycleError, TopologicalSorter

from ..model import LinkDef, ModelDef, Registry

MAX_DEPTH = 3


def dependencies(registry: Registry, names: Iterable[str]) -> dict[str, set[str]]:
    """To-one targets of each model among ``names``, itself left out."""
    wanted = list(dict.fromkeys(names))
    return {n: {r.target for r in registry.model(n).relations if not r.is_list and r.target in wanted and r.target != n} for n in wanted}


def sorted_by_dependency(registry: Registry, names: Iterable[str]) -> list[str]:
    """Models after what they refer to. A cycle raises ValueError."""
    try:
        return list(TopologicalSorter(dependencies(registry, names)).static_order())
    except CycleError as e:
        raise ValueError(f"models depend on each other: {e.args[1]}") from e


def path_to(registry: Registry, start: str, goal: str, max_depth: int = 5) -> str | None:
    """The shortest dotted path of to-one relations, None beyond max_depth. From a model to itself only a real cycle counts."""
    queue: deque[tuple[str, tuple[str, ...]]] = deque([(start, ())])
    seen: set[str] = set()
    while queue:
        at, path = queue.popleft()
        if len(path) == max_depth:
            continue
        for r in registry.model(at).relations:
            if r.is_list:
                continue
            if r.target == goal:
                return ".".join([*path, r.name])
            if r.target not in seen and r.target in registry.models:
                seen.add(r.target)
                queue.append((r.target, (*path, r.name)))
    return None


def parent_filter(registry: Registry, start: str, goal: str, key: str, value: object) -> dict[str, object]:
    """An example filter for rows under a parent: a dotted path to its key, or <goal>Id where no path leads there."""
    path = path_to(registry, start, goal)
    return {f"{path}.{key}": value} if path else {f"{goal[:1].lower()}{goal[1:]}Id": value}


Tree = Mapping[str, "Tree"]


def include_tree(registry: Registry, model: ModelDef, wanted: object, depth: int = 0) -> dict[str, dict]:
    """Relations to include, by name, each with its own tree.

    "*" is all relations, one level; a list holds names or {name: subtree}, a mapping the latter. Unknown relations and what lies
    deeper than MAX_DEPTH below the first level are left out.
    """
    names = {r.name: r.target for r in model.relations} | {x.name: x.target for x in model.links}
    if not wanted or depth > MAX_DEPTH:
        return {}
    if wanted == "*":
        return {n: {} for n in names}
    if isinstance(wanted, str):
        wanted = [wanted]
    pairs: list[tuple[str, object]] = []
    for item in wanted.items() if isinstance(wanted, Mapping) else wanted:
        if isinstance(item, str):
            pairs.append((item, None))
        elif isinstance(item, Mapping):
            pairs.extend(item.items())
        elif isinstance(item, tuple) and len(item) == 2:
            pairs.append(item)
    return {n: include_tree(registry, registry.model(names[n]), sub, depth + 1) for n, sub in pairs if n in names}


def relation_type(model: ModelDef, name: str) -> str:
    """explicit for links, which are declared; one-to-many and to-one for relations. No guess is made from a target's shape."""
    if model.link_named(name):
        return "explicit"
    r = model.relation_named(name)
    if r is None:
        raise KeyError(f"{model.name}.{name}")
    return "one-to-many" if r.is_list else "to-one"


def join_table(registry: Registry, model: ModelDef, name: str) -> dict[str, object]:
    """Table, keys and extra columns of a link."""
    link: LinkDef | None = model.link_named(name)
    if link is None:
        raise KeyError(f"{model.name}.{name}")
    table = registry.model(link.table)
    return {"table": link.table, "source_key": link.source_key, "target_key": link.target_key, "extras": [f.name for f in table.fields if f.name not in (link.source_key, link.target_key)]}


def link_pairs(model: ModelDef, item: Mapping[str, object]) -> tuple[dict[str, object], dict[str, list], dict[str, list]]:
    """An item without its declared links, the links' target ids, and the rows to create by target model.

    A link is a list of ids, of {id} or of whole rows, or {connect: such a list, create: rows}; rows bring their ids.
    """
    rest, links, made = {}, {}, {}
    for k, v in item.items():
        link = model.link_named(k)
        if link is None:
            rest[k] = v
            continue
        new = []
        if isinstance(v, Mapping) and v.keys() & {"connect", "create"}:
            new = _listed(v.get("create"))
            v = _listed(v.get("connect"))
        given = _listed(v)
        whole = [x for x in given if isinstance(x, Mapping) and x.keys() != {"id"}]
        links[k] = [x["id"] if isinstance(x, Mapping) else x for x in [*given, *new]]
        if new or whole:
            made.setdefault(link.target, []).extend([*new, *whole])
    return rest, links, made


def _listed(v: object) -> list:
    return [x for x in (v if isinstance(v, (list, tuple)) else [v]) if x is not None]


def related_rows(model: ModelDef, item: Mapping[str, object]) -> tuple[dict[str, object], dict[str, list]]:
    """An item whose to-one relations are keys, and the rows to create by target model: a relation given as {create: row}, or as a row."""
    rest, made = dict(item), {}
    for k, v in item.items():
        r = model.relation_named(k)
        if r is None or r.is_list or not isinstance(v, Mapping) or "connect" in v or v.keys() == {"id"}:
            continue
        row = v.get("create", v)
        made.setdefault(r.target, []).append(row)
        del rest[k]
        for own, other in zip(r.local, r.remote):
            rest.setdefault(own, row[other])
    return rest, made
