"""Search trees and query-by-example filters compiled to Columns; relations become correlated EXISTS, which Catalyst turns into joins."""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..model import ModelDef, Registry, RelationDef, UnknownField
from .search import And, Condition, Node, Not, Or, is_valid_value, parse

_FRESH = itertools.count()
_SOURCE = "__source"


class Compiler:
    """Compiles for rows of a model under an alias.

    Three-valued logic is that of SQL, with one addition: a range on a column that isn't required also demands a value, so the
    negation of such a range holds for null. ``insensitive`` is the default for text operators other than equality.
    Lists of over ``list_limit`` values are compared as a key table, by EXISTS.
    """

    def __init__(self, registry: Registry, insensitive: bool = True, list_limit: int = 10_000, strict_nested: bool = False):
        self.registry, self.insensitive, self.list_limit, self.strict_nested = registry, insensitive, list_limit, strict_nested

    def search(self, model: ModelDef, alias: str, tree: object) -> Column | None:
        node = parse(tree)
        return None if node is None else self._node(model, alias, node, False)

    def _node(self, model: ModelDef, alias: str, node: Node, negated: bool) -> Column | None:
        if isinstance(node, Not):
            inner = self._node(model, alias, node.child, True)
            return None if inner is None else ~inner
        if isinstance(node, (And, Or)):
            parts = [p for p in (self._node(model, alias, c, negated) for c in node.children) if p is not None]
            if not parts:
                return None
            return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)
        return self._path(model, alias, node.field.split("."), node, negated)

    # -- paths ------------------------------------------------------------------------------------

    def _path(self, model: ModelDef, alias: str, path: list[str], cond: Condition, negated: bool) -> Column | None:
        head, rest = path[0], path[1:]
        relation = _as_relation(model, head)
        if relation is not None:
            return self._related(model, alias, relation, rest, cond, negated)
        f = model.field_named(head)
        if f is None:
            raise UnknownField(f"{model.name}.{head}")
        c = F.col(f"{alias}.{head}")
        if f.kind == "json":
            return P.json_match(c, rest, cond.ops, self._text_flag(cond)) if rest else self._leaf(c, f.type, cond, f.required, negated)
        return self._inside(c, f.type, rest, cond, f.required, negated)

    def _inside(self, c: Column, kind: T.DataType, rest: list[str], cond: Condition, required: bool, negated: bool) -> Column | None:
        if not rest:
            return self._leaf(c, kind, cond, required, negated)
        if isinstance(kind, T.StructType):
            if rest[0] not in kind.names:
                raise UnknownField(rest[0])
            inner = self._inside(c[rest[0]], kind[rest[0]].dataType, rest[1:], cond, False, negated)
            return inner
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            every = cond.relation == "every"
            probe = self._inside(F.lit(None).cast(kind.elementType), kind.elementType, rest, cond, False, negated)
            if probe is None:
                return None

            def test(x: Column) -> Column:
                p = self._inside(x, kind.elementType, rest, cond, False, negated or every)
                return F.coalesce(~p if every else p, F.lit(False))

            found = F.coalesce(F.exists(c, test), F.lit(False))
            return found if cond.relation == "some" else ~found
        raise UnknownField(".".join(rest))

    def _related(self, model: ModelDef, alias: str, relation: RelationDef, rest: list[str], cond: Condition, negated: bool) -> Column | None:
        if not rest:
            if cond.ops.get("isNull") or cond.ops.get("equals", 0) is None:
                return ~self._exists(alias, relation, None)
            return None
        child = self.registry.model(relation.target)
        below = f"h{next(_FRESH)}"
        every = relation.is_list and cond.relation == "every"
        inner = self._path(child, below, rest, cond, negated or every)
        if inner is None:
            return None
        if not relation.is_list or cond.relation == "some":
            return self._exists(alias, relation, inner, below)
        if cond.relation == "none":
            return ~self._exists(alias, relation, inner, below)
        return ~self._exists(alias, relation, ~inner, below)

    def _exists(self, alias: str, relation: RelationDef, inner: Column | None, below: str | None = None) -> Column:
        below = below or f"h{next(_FRESH)}"
        rows = self._target_rows(relation).alias(below)
        match = reduce(lambda a, b: a & b, [F.col(f"{below}.{r}") == F.col(f"{alias}.{k}").outer() for k, r in zip(relation.local, relation.remote)])
        return rows.where(match if inner is None else match & inner).exists()

    def _target_rows(self, relation: RelationDef) -> DataFrame:
        target = self.registry.df(relation.target)
        if relation.through is not None:  # the target's rows, once for each link row
            link = relation.through
            links = self.registry.df(link.table).select(F.col(link.source_key).alias(_SOURCE), F.col(link.target_key).alias("__key"))
            return target.join(links, target[self.registry.model(relation.target).id_fields[0]] == links["__key"]).drop("__key")
        return target

    # -- leaves -----------------------------------------------------------------------------------

    def _text_flag(self, cond: Condition) -> bool:
        if cond.insensitive is not None:
            return cond.insensitive
        return self.insensitive and "equals" not in cond.ops

    def _leaf(self, c: Column, kind: T.DataType, cond: Condition, required: bool, negated: bool) -> Column | None:
        p = self._operator(c, kind, cond, required, negated)
        return p if p is None or not cond.or_null else p | c.isNull()

    def _operator(self, c: Column, kind: T.DataType, cond: Condition, required: bool, negated: bool) -> Column | None:
        ops = cond.ops
        (op, value), *_ = ops.items()
        if op == "isNull":
            return c.isNull()
        if op == "equals":
            return P.equals(c, value, kind, self._text_flag(cond))
        if op in ("like", "startsWith", "endsWith"):
            return P.text_match(c, op, value, self._text_flag(cond))
        if op in ("in", "notIn"):
            found = self._member(c, kind, value, negated or op == "notIn")
            return found if op == "in" else ~found
        if op == "hasSome":
            return P.has_some(c, value, kind)
        if op == "hasEvery":
            return P.has_every(c, value, kind)
        p = P.within(c, ops, kind)
        return p if required or cond.or_null else p & c.isNotNull()

    def _member(self, c: Column, kind: T.DataType, values: list[object], negated: bool) -> Column:
        if len(values) <= self.list_limit:
            return c.isin(*[P.literal(v, kind) if not isinstance(v, (str, int, float)) else v for v in values])
        keys = self._spark().createDataFrame([(v,) for v in dict.fromkeys(values)], T.StructType([T.StructField("k", kind)]))
        below = f"h{next(_FRESH)}"
        found = keys.alias(below).where(F.col(f"{below}.k") == c.outer()).exists()
        # where a negation may stand above, null must stay null
        return found | F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(False) if negated else found

    def _spark(self):
        return next(iter(self.registry.snapshots.values())).sparkSession

    # -- query by example -------------------------------------------------------------------------

    def example(self, model: ModelDef, alias: str, values: Mapping[str, object] | None) -> Column | None:
        """The conjunction that a mapping of field to value stands for: null, equality, all of a list, and one related row."""
        parts = []
        for name, value in (values or {}).items():
            p = self._example(model, alias, name, value)
            if p is not None:
                parts.append(p)
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _example(self, model: ModelDef, alias: str, name: str, value: object) -> Column | None:
        if "." in name:
            if value is not None and not is_valid_value(value):
                return None
            ops = {"hasEvery": list(value)} if isinstance(value, (list, tuple)) else {"equals": value}
            return self._path(model, alias, name.split("."), Condition(name, ops, insensitive=False), False)
        relation = _as_relation(model, name)
        if relation is None and model.field_named(name) is None:
            raise UnknownField(f"{model.name}.{name}")
        if isinstance(value, Mapping):
            if self.strict_nested and not is_valid_value(value):
                return None
            if relation is not None:
                below = f"h{next(_FRESH)}"
                inner = self.example(self.registry.model(relation.target), below, self._kept(value))
                return None if inner is None else self._exists(alias, relation, inner, below)
            return self._example_inside(F.col(f"{alias}.{name}"), model.field_named(name).type, self._kept(value))
        if relation is not None:
            return ~self._exists(alias, relation, None) if value is None else None
        f = model.field_named(name)
        c = F.col(f"{alias}.{name}")
        if value is None:
            return c.isNull()
        if not is_valid_value(value):
            return None
        return P.has_every(c, value, f.type) if isinstance(value, (list, tuple)) else P.equals(c, value, f.type, False)

    @staticmethod
    def _kept(value: Mapping[str, object]) -> dict[str, object]:
        return {k: v for k, v in value.items() if is_valid_value(v) or isinstance(v, Mapping)}

    def _example_inside(self, c: Column, kind: T.DataType, value: Mapping[str, object]) -> Column | None:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if self._example_inside(F.lit(None).cast(kind.elementType), kind.elementType, value) is None:
                return None
            return F.coalesce(F.exists(c, lambda x: F.coalesce(self._example_inside(x, kind.elementType, value), F.lit(False))), F.lit(False))
        parts = []
        for k, v in value.items():
            if not isinstance(kind, T.StructType) or k not in kind.names:
                raise UnknownField(k)
            inner, own = kind[k].dataType, c[k]
            if isinstance(v, Mapping):
                p = self._example_inside(own, inner, self._kept(v))
            else:
                p = P.has_every(own, v, inner) if isinstance(v, (list, tuple)) else P.equals(own, v, inner, False)
            if p is not None:
                parts.append(p)
        return reduce(lambda a, b: a & b, parts) if parts else None


def _as_relation(model: ModelDef, name: str) -> RelationDef | None:
    """A relation by name; a link is one to many over the target's rows joined to the link table."""
    link = model.link_named(name)
    if link is None:
        return model.relation_named(name)
    return RelationDef(name, link.target, model.id_fields[:1], (_SOURCE,), True, through=link)
