"""Searches over a model: filter, order, page, count, and related rows loaded along."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Registry, RelationDef, require
from ..plans.compiler import Compiler, _as_relation
from ..plans.graph import include_tree

ROOT = "h"


@dataclass(frozen=True)
class Page:
    total: int
    page: int | None
    page_size: int | None
    data: DataFrame


class EntityQuery:
    """Lazy but for counts: every search is one plan, whatever its shape."""

    def __init__(self, registry: Registry, name: str, **how: object):
        self.registry, self.model = registry, registry.model(name)
        config = registry.config
        self.compiler = Compiler(registry, **{"insensitive": config.insensitive_search, "list_limit": config.list_limit, "strict_nested": config.strict_nested, **how})

    def predicate(self, base: Mapping[str, object] | None = None, search: object = None) -> Column | None:
        """base AND search, for rows under the alias ROOT; None if neither says anything."""
        parts = [p for p in (self.compiler.example(self.model, ROOT, base), self.compiler.search(self.model, ROOT, search)) if p is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def rows(self, base: Mapping[str, object] | None = None, search: object = None) -> DataFrame:
        df = self.registry.df(self.model.name).alias(ROOT)
        p = self.predicate(base, search)
        return df if p is None else df.where(p)

    def find(self, base: Mapping[str, object] | None = None, search: object = None, order_by: object = None, take: int | None = None, skip: int | None = None, page: int | None = None, page_size: int | None = None, include: object = None, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """Matching rows. Ordered ones are ordered to the end, by the identity last; so are pages without an order.

        Nulls come first in ascending order and last in descending. page, from 1, and page_size say take and skip where these don't.
        ``include`` names relations to load along, ``columns`` by dotted relation the columns of it to load, all if it isn't named.
        """
        df = self.rows(base, search)
        if page_size and take is None:
            take, skip = page_size, (max(page or 1, 1) - 1) * page_size if skip is None else skip
        keys = self._order(order_by, bool(take is not None or skip))
        if keys:
            df = df.orderBy(*keys)
        if skip:
            df = df.offset(skip)
        if take is not None:
            df = df.limit(take)
        if include:
            df = self.with_related(df, include, columns, take)
            if keys:
                df = df.alias(ROOT).orderBy(*keys)
        return df

    def page(self, base: Mapping[str, object] | None = None, search: object = None, page: int | None = None, page_size: int | None = None, **rest: object) -> Page:
        """The rows of a page, and how many there are on all pages."""
        return Page(self.count(base, search), page, page_size, self.find(base, search, page=page, page_size=page_size, **rest))

    def only_one(self, base: Mapping[str, object] | None = None, search: object = None, **rest: object) -> Row | None:
        self.registry.throttle()
        return next(iter(self.find(base, search, **{**rest, "take": 1}).collect()), None)

    def count_df(self, base: Mapping[str, object] | None = None, search: object = None) -> DataFrame:
        return self.rows(base, search).agg(F.count("*").alias("total"))

    def count(self, base: Mapping[str, object] | None = None, search: object = None) -> int:
        self.registry.throttle()
        return self.count_df(base, search).first()["total"]

    def probe(self, values: Mapping[str, object]) -> Row | None:
        """The first row that agrees with ``values`` on a unique constraint, constraints in order, those with nulls passed over."""
        for key in self.model.unique_constraints():
            if all(values.get(k) is not None for k in key):
                found = self.only_one({k: values[k] for k in key})
                if found is not None:
                    return found
        return None

    def by_keys(self, keys: DataFrame, on: Iterable[str]) -> DataFrame:
        """Rows whose ``on`` columns occur in keys."""
        return self.registry.df(self.model.name).join(keys.select(*on).distinct(), list(on), "left_semi")

    def _order(self, order_by: object, page: bool) -> list[Column]:
        items = [order_by] if isinstance(order_by, Mapping) else list(order_by or [])
        keys, named = [], []
        for item in items:
            for name, way in item.items():
                require(self.model, [name])
                c = F.col(f"{ROOT}.{name}")
                keys.append(c.desc() if str(way).lower() == "desc" else c.asc())
                named.append(name)
        if keys or page:
            keys += [F.col(f"{ROOT}.{k}").asc() for k in self.model.id_fields if k not in named]
        return keys

    # -- eager loading ----------------------------------------------------------------------------

    def with_related(self, df: DataFrame, include: object, columns: Mapping[str, Sequence[str]] | None = None, rows: int | None = None) -> DataFrame:
        """df with a column for each included relation: a struct or null for to-one, an array for to-many, ordered by identity or,
        in models without one, by all columns that have an order.

        Related rows are gathered by key before the join, so that rows of df never multiply. Where df is known to have at most
        ``rows`` rows, only related rows of its keys are read into the aggregation; few keys are broadcast.
        """
        tree = include_tree(self.registry, self.model, include)
        return self._load(df, self.model.name, tree, columns or {}, "", rows)

    def _load(self, df: DataFrame, name: str, tree: Mapping[str, Mapping], columns: Mapping[str, Sequence[str]], path: str, rows: int | None) -> DataFrame:
        model = self.registry.model(name)
        for rel, sub in tree.items():
            df = self._join_related(df, _as_relation(model, rel), sub, columns, f"{path}{rel}", rows)
        return df

    def _join_related(self, df: DataFrame, relation: RelationDef, sub: Mapping[str, Mapping], columns: Mapping[str, Sequence[str]], path: str, limit: int | None) -> DataFrame:
        target = self.registry.model(relation.target)
        rows = self.compiler._target_rows(relation) if relation.through else self.registry.df(relation.target)
        keys = [f"__k{i}" for i in range(len(relation.remote))]
        if limit is not None:
            wanted = df.select(*(F.col(a).alias(k) for a, k in zip(relation.local, keys))).distinct()
            wanted = F.broadcast(wanted) if limit <= _FEW else wanted
            rows = rows.join(wanted, reduce(lambda a, b: a & b, [rows[r] == wanted[k] for r, k in zip(relation.remote, keys)]), "left_semi")
        chosen = columns.get(path)
        require(target, chosen or ())
        names = [f.name for f in target.fields if f.name in rows.columns and (chosen is None or f.name in chosen)] + list(sub)
        # of a to-many relation of a page the related rows have no known number: below it keys are used, but not broadcast
        below = None if limit is None else limit if not relation.is_list else _FEW + 1
        rows = self._load(rows, relation.target, sub, columns, f"{path}.", below)
        order = target.id_fields or tuple(f.name for f in target.fields if f.name in rows.columns and _ordered(f.type))
        remote = [F.col(r).alias(k) for r, k in zip(relation.remote, keys)]
        if relation.is_list:
            if list(order) == names:  # the row is its own order
                packed = rows.select(*remote, F.struct(*names).alias("row")).groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias(relation.name))
            else:
                pair = F.struct(F.struct(*order).alias("order"), F.struct(*names).alias("row"))
                sorted_pairs = F.array_sort(F.collect_list("pair"))
                packed = rows.select(*remote, pair.alias("pair")).groupBy(*keys).agg(F.transform(sorted_pairs, lambda p: p["row"]).alias(relation.name))
        else:
            packed = rows.select(*remote, F.struct(*names).alias(relation.name))
        match = reduce(lambda a, b: a & b, [df[a] == packed[k] for a, k in zip(relation.local, keys)])
        joined = df.join(packed, match, "left").drop(*keys)
        if relation.is_list:
            empty = F.array().cast(packed.schema[relation.name].dataType)
            joined = joined.withColumn(relation.name, F.coalesce(relation.name, empty))
        return joined


_FEW = 10_000


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType)) and (not isinstance(kind, T.ArrayType) or _ordered(kind.elementType)) and (not isinstance(kind, T.StructType) or all(_ordered(f.dataType) for f in kind))
