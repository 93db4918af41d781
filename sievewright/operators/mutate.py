"""Set-based mutations over immutable snapshots: each is one plan from the old snapshot to the new one."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import differs
from ..functions.rows import first_by_keys, foreign_keys, sanitize_keys, update_payload
from ..model import LinkDef, ModelDef, Registry, RelationDef, UnknownField
from ..plans.graph import link_pairs, related_rows
from ..runtime.control import in_parallel
from ..runtime.lineage import cut
from .query import ROOT, EntityQuery

_NEW = "__new_"
_BOOK = ("_present", "_ord")
CREATED, UPDATED, UNCHANGED, DELETED = "created", "updated", "unchanged", "deleted"


def _all(parts: Iterable[Column]) -> Column:
    return reduce(operator.and_, parts, F.lit(True))


def _any(parts: Iterable[Column]) -> Column:
    return reduce(operator.or_, parts, F.lit(False))


def _spread(key: Sequence[Column], by: Sequence[Column]) -> Column:
    return F.when(_any(k.isNull() for k in key), F.xxhash64(*by)).otherwise(0)


_STATUS, _ORDER = "__status", "__order"


@dataclass(frozen=True)
class Change:
    """What a mutation makes of its model, as one plan: the model's columns, __status of the rows it looked at (null for others)
    and, for rows that came in, __order. ``snapshot`` and ``rows`` are views of that plan, all lazy."""

    marked: DataFrame
    names: tuple[str, ...]
    id_fields: tuple[str, ...]
    removed: DataFrame | None = None  # (n): incoming rows that a later one with the same key replaced
    incoming_links: Mapping[str, DataFrame] = field(default_factory=dict)  # by link: (__order, target)
    related: Mapping[str, Sequence[Mapping[str, object]]] = field(default_factory=dict)  # rows of other models that came along
    after: tuple[Callable, ...] = ()
    name: str = "change"

    @property
    def snapshot(self) -> DataFrame:
        """The model's rows from now on."""
        return self.marked.where(F.col(_STATUS).isNull() | (F.col(_STATUS) != DELETED)).select(*self.names)

    @property
    def rows(self) -> DataFrame:
        """(identity, status) of each row that was looked at."""
        return self.marked.where(F.col(_STATUS).isNotNull()).select(*self.id_fields, F.col(_STATUS).alias("status"))

    def counts(self) -> dict[str, int]:
        """created + updated + unchanged = total; rows replaced by a later one count as unchanged."""
        found = {r["status"]: r["n"] for r in self.rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        out = {k: found.get(k, 0) for k in (CREATED, UPDATED, UNCHANGED)}
        if self.removed is not None:
            out[UNCHANGED] += self.removed.first()["n"] or 0
        return {**out, "total": sum(out.values())}

    def ids(self, status: str) -> DataFrame:
        return self.rows.where(F.col("status") == status).drop("status")

    def links(self, name: str) -> DataFrame:
        """(source, target) of the link that created and updated rows brought along."""
        made = self.marked.where(F.col(_STATUS).isin(CREATED, UPDATED)).select(F.col(self.id_fields[0]).alias("source"), _ORDER)
        return made.join(self.incoming_links[name], _ORDER).select("source", "target")

    def stored(self, registry: Registry) -> Change:
        """The same, computed once and kept: no more of its plan is carried on, and times stand still."""
        return replace(self, marked=registry.kept(self.marked))


class Mutations:
    """Mutations of one model. ``apply`` stores a change and binds its snapshot; until then nothing has happened.

    ``compare`` is strict or normalized (see ``differs``). A key with a null never matches. Columns that a row doesn't provide
    (its ``_present``) keep their value, an explicit null is written. Rows of a DataFrame without ``_present`` provide all its columns.
    Hooks of the registry's configuration run before those given here.
    """

    def __init__(self, registry: Registry, name: str, compare: str | None = None, before: Sequence[Callable] = (), after: Sequence[Callable] = (), foreign_key: Callable[[str], str] | None = None):
        """``foreign_key`` names the key column of a relation given as an object; else it is the relation's own, or <relation>Id."""
        self.registry, self.model, self.compare = registry, registry.model(name), compare or registry.config.compare
        self.before, self.after = (*registry.config.before, *before), (*registry.config.after, *after)
        self.names = [f.name for f in self.model.fields]
        self.foreign_key = foreign_key or self._foreign_key

    def _foreign_key(self, relation: str) -> str:
        found = self.model.relation_named(relation)
        return found.local[0] if found is not None and not found.is_list and len(found.local) == 1 else f"{relation}Id"

    @property
    def target(self) -> DataFrame:
        return self.registry.df(self.model.name)

    def apply(self, change: Change) -> Change:
        """Computes and stores the change, binds its snapshot and those of its links, and runs the hooks that come after.

        Rows of related models that came along with the items are created first; those whose keys exist are left as they are.

        Nothing is bound if any of it fails; attempts are repeated where an error may pass.
        """
        registry = self.registry
        for name, rows in change.related.items():
            other = Mutations(registry, name)
            other.apply(other.create_many(rows))
        with registry.metrics.timed(change.name, self.model.name) as found:
            registry.throttle()
            change = change.stored(registry)
            tables = {}
            for name in change.incoming_links:
                link = self._link(name)
                tables[link.table] = registry.kept(self.apply_links(name, change.links(name)))
            found["rows"] = change.rows.count()
        registry.bind(self.model.name, change.snapshot)
        for name, df in tables.items():
            registry.bind(name, df)
        for hook in change.after:
            hook(self.model.name, change)
        return change

    def incoming(self, items: DataFrame | Iterable[Mapping[str, object]], order: str | None = None) -> DataFrame:
        """Rows under the model's names with _present and _ord; dicts may carry leading underscores, relation objects and links.

        ``order`` names the column of a DataFrame by which later rows win. Without one, and without _ord, rows are ordered by their
        hash: which of several rows with one key wins is then arbitrary, but the same each time the plan runs.
        """
        return self._incoming(items, order, False)[0]

    def _incoming(self, items: DataFrame | Iterable[Mapping[str, object]], order: str | None, links: bool) -> tuple[DataFrame, dict[str, object]]:
        """Rows, and what else a change needs to know of them: links and related rows."""
        if not isinstance(items, DataFrame):
            parts, related, clean = [], {}, []
            for x in items:
                rest, own, new = link_pairs(self.model, sanitize_keys(x))
                rest, made = related_rows(self.model, rest)
                parts.append(own)
                clean.append(foreign_keys(rest, self.foreign_key))
                for name, rows in [*made.items(), *(new.items() if links else ())]:
                    related.setdefault(name, []).extend(rows)
            rows = self.registry.rows(self.model.name, clean)
            if not links:
                return rows, {"related": related}
            pairs = {x.name: self._link_rows(x, [(n, t) for n, own in enumerate(parts) for t in own.get(x.name, ())]) for x in self.model.links if any(x.name in own for own in parts)}
            return rows, {"related": related, "incoming_links": pairs}
        linked = [x for x in self.model.links if x.name in items.columns]
        unknown = [c for c in items.columns if c not in self.names and c not in _BOOK and c not in [x.name for x in linked]]
        if unknown:
            raise UnknownField(f"{self.model.name}: {unknown}")
        given = [c for c in items.columns if c in self.names]
        present = F.col("_present") if "_present" in items.columns else F.array(*[F.lit(c) for c in given])
        hashed = [c for c, t in items.dtypes if "map<" not in t and "variant" not in t]
        nth = F.col("_ord") if "_ord" in items.columns else F.col(order) if order else F.xxhash64(*hashed)
        fields = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.type).alias(f.name) for f in self.model.fields]
        rows = items.select(*fields, present.alias("_present"), nth.alias("_ord"))
        pairs = {}
        for x in linked if links else ():
            element = items.schema[x.name].dataType.elementType
            own = F.explode(x.name)
            target = items.select(nth.alias(_ORDER), own.alias("t"))
            pairs[x.name] = target.select(_ORDER, (F.col("t.id") if isinstance(element, T.StructType) else F.col("t")).alias("target"))
        return rows, {"incoming_links": pairs}

    def _link_rows(self, link: LinkDef, pairs: list[tuple[int, object]]) -> DataFrame:
        kind = self.registry.model(link.table).field_named(link.target_key).type
        return self.target.sparkSession.createDataFrame(pairs, T.StructType([T.StructField(_ORDER, T.LongType()), T.StructField("target", kind)]))

    def _change(self, marked: DataFrame, **rest: object) -> Change:
        return Change(marked, tuple(self.names), tuple(self.model.id_fields), **rest)

    def _key(self, key: Sequence[str] | None) -> list[str]:
        found = list(key or next(iter(self.model.unique_constraints()), ()))
        if not found:
            raise ValueError(f"{self.model.name} has no unique key")
        return found

    def last_wins(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """The last row of each key; rows with a null in the key all stay. Only complete keys are shuffled."""
        full = _all(F.col(k).isNotNull() for k in key)
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_ord").desc()))
        return rows.where(full).withColumn("__n", nth).where("__n = 1").drop("__n").unionByName(rows.where(~full))

    def _written(self, key: Sequence[str]) -> list[str]:
        own = {*key, *self.model.id_fields, self.model.created_at, self.model.updated_at}
        return [n for n in self.names if n not in own]

    def _given(self, name: str) -> Column:
        return F.array_contains(f"{_NEW}_present", name)

    def _renamed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).alias(_NEW + c) for c in rows.columns))

    def _changed(self, key: Sequence[str]) -> Column:
        kind = {f.name: f.type for f in self.model.fields}
        return _any(self._given(n) & differs(F.col(n), F.col(_NEW + n), kind[n], self.compare) for n in self._written(key))

    def _fresh_columns(self, prefix: str = "") -> dict[str, Column]:
        """Values of a row to insert: defaults where a column isn't provided, times of creation, an error where a required value is missing."""
        cols = {}
        for f in self.model.fields:
            c = F.col(prefix + f.name)
            if f.name in (self.model.created_at, self.model.updated_at):
                c = F.coalesce(c, F.current_timestamp().cast(f.type))
            elif f.has_default:
                c = F.when(F.array_contains(f"{prefix}_present", f.name), c).otherwise(F.lit(f.default).cast(f.type))
            if f.required and not f.is_id and f.name not in self.model.primary_key:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"{self.model.name}.{f.name} is required")).cast(f.type)).otherwise(c)
            if f.values:
                known = c.isNull() | c.isin(*f.values)
                c = F.when(known, c).otherwise(F.raise_error(F.concat(F.lit(f"{self.model.name}.{f.name} has no value "), c.cast("string"))).cast(f.type))
            cols[f.name] = c
        return cols

    def _merge(self, rows: DataFrame, key: Sequence[str], insert: bool) -> DataFrame:
        """Target and rows joined once, marked: rows that match take the provided values if these differ; others are inserted, or left out.

        The join reads the target once. Without inserts it is a left join, which lets a small side be broadcast by its measured size.
        Rows with a null in the key match nothing, but a full join keeps them: they are spread by a hash, or one task would get them all.
        """
        old = self.target.withColumn("__there", F.lit(True))
        new = self._renamed(rows)
        match = [(k, _NEW + k) for k in key]
        if insert and not all(self.model.field_named(k).required for k in key):
            old = old.withColumn("__spread", _spread([F.col(k) for k in key], [F.col(k) for k in self.model.id_fields]))
            new = new.withColumn(f"{_NEW}_spread", _spread([F.col(_NEW + k) for k in key], [F.col(f"{_NEW}_ord")]))
            match.append(("__spread", f"{_NEW}_spread"))
        joined = old.join(new, _all(old[a] == new[b] for a, b in match), "full" if insert else "left")
        came, there = F.col(f"{_NEW}_present").isNotNull(), F.col("__there").isNotNull()
        changed = came & there & self._changed(key)
        fresh = self._fresh_columns(_NEW)
        cols = []
        for f in self.model.fields:
            n, c = f.name, F.col(f.name)
            if n in self._written(key):
                c = F.when(changed & self._given(n), F.col(_NEW + n)).otherwise(c)
            elif n == self.model.updated_at:
                c = F.when(changed, F.current_timestamp().cast(f.type)).otherwise(c)
            cols.append((F.when(there, c).otherwise(fresh[n]) if insert else c).alias(n))
        status = F.when(came, F.when(~there, CREATED).when(changed, UPDATED).otherwise(UNCHANGED))
        return joined.select(*cols, status.alias(_STATUS), F.col(f"{_NEW}_ord").alias(_ORDER))

    # -- create, upsert ---------------------------------------------------------------------------

    def create_many(self, items: DataFrame | Iterable[Mapping[str, object]], skip_duplicates: bool = True, order: str | None = None, links: bool = True) -> Change:
        """Inserts rows whose complete unique keys neither occur in the target nor, earlier, among the rows; links come along.

        A list is thinned in order, over all keys at once. A DataFrame is, key by key, reduced to the first row of each by
        ``order``; for one unique key that is the same. Without ``skip_duplicates`` a key that exists already raises when the
        snapshot is computed.
        """
        keys = self.model.unique_constraints()
        thin = items if isinstance(items, DataFrame) else first_by_keys([sanitize_keys(x) for x in items], keys)
        rows, more = self._incoming(thin, order, links)
        if isinstance(items, DataFrame):
            for key in keys:
                full = _all(F.col(k).isNotNull() for k in key)
                nth = F.row_number().over(Window.partitionBy(*key).orderBy("_ord"))
                rows = rows.where(full).withColumn("__n", nth).where("__n = 1").drop("__n").unionByName(rows.where(~full))
        for key in keys:
            old = self.target.select(*(F.col(k).alias(f"__old_{k}") for k in key))
            match = _all(rows[k] == old[f"__old_{k}"] for k in key)
            if skip_duplicates:
                rows = rows.join(old, match, "left_anti")
            else:
                first = F.col(f"__old_{key[0]}")
                error = F.raise_error(F.lit(f"{self.model.name}: unique key exists: {'+'.join(key)}")).cast("boolean")
                rows = rows.join(old.distinct(), match, "left").where(F.when(first.isNotNull(), error).otherwise(True)).drop(*old.columns)
        made = rows.select(*(c.alias(n) for n, c in self._fresh_columns().items()), F.lit(CREATED).alias(_STATUS), F.col("_ord").alias(_ORDER))
        kept = self.target.select(*self.names, F.lit(None).cast("string").alias(_STATUS), F.lit(None).cast(made.schema[_ORDER].dataType).alias(_ORDER))
        return self._change(kept.unionByName(made), **more, name="create")

    def classify(self, items: DataFrame | Iterable[Mapping[str, object]], key: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
        """(fields.., status) of the rows that count."""
        key = self._key(key)
        rows = self.last_wins(self.incoming(items, order), key)
        new = self._renamed(rows)
        old = self.target.select(*dict.fromkeys([*self.model.id_fields, *key, *self._written(key)]), F.lit(True).alias("__there"))
        joined = new.join(old, _all(new[_NEW + k] == old[k] for k in key), "left")
        status = F.when(F.col("__there").isNull(), CREATED).when(self._changed(key), UPDATED).otherwise(UNCHANGED)
        return joined.select(*(F.col(_NEW + n).alias(n) for n in self.names), status.alias("status"))

    def upsert_many(self, items: DataFrame | Iterable[Mapping[str, object]], key: Sequence[str] | None = None, order: str | None = None, links: bool = True) -> Change:
        """Inserts rows of new keys and writes provided values that differ into the others; the last row of a key wins.

        Links of created and updated rows come along. Hooks before run now, hooks after when the change is applied.
        """
        key = self._key(key)
        for hook in self.before:
            hook(self.model.name, items)
        rows, more = self._incoming(items, order, links)
        full = _all(F.col(k).isNotNull() for k in key)
        replaced = rows.where(full).agg((F.count("*") - F.count_distinct(F.struct(*key))).alias("n"))
        return self._change(self._merge(self.last_wins(rows, key), key, True), removed=replaced, **more, after=self.after, name="upsert")

    # -- update, delete ---------------------------------------------------------------------------

    def update_many_by_id(self, items: DataFrame | Iterable[Mapping[str, object]], order: str | None = None) -> Change:
        """Writes provided values into rows of the same identity; the last of a repeated id wins, unknown ids do nothing."""
        key = self._key(self.model.id_fields)
        rows, more = self._incoming(items if isinstance(items, DataFrame) else [update_payload(x, self.model.created_at) for x in items], order, False)
        rows = self.last_wins(rows.where(_all(F.col(k).isNotNull() for k in key)), key)
        return self._change(self._merge(rows, key, False), **more, name="update")

    def _matching(self, base: Mapping[str, object] | None, search: object) -> Column:
        found = EntityQuery(self.registry, self.model.name).predicate(base, search)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    def update_by_filter(self, base: Mapping[str, object] | None, data: Mapping[str, object | Column], search: object = None) -> Change:
        """Sets values, or Columns over the row's own fields, where the filter holds. Ids and createdAt aren't written; no data changes nothing."""
        data = {k: v for k, v in update_payload({k: v for k, v in data.items() if k in self.names}, self.model.created_at).items() if k not in self.model.id_fields}
        rows, hit = self.target.alias(ROOT), self._matching(base, search)
        marked = rows.withColumn("__hit", hit if data else F.lit(False))
        stamp = self.model.updated_at in self.names and self.model.updated_at not in data
        cols = []
        for f in self.model.fields:
            c = F.col(f.name)
            if f.name in data:
                c = F.when(F.col("__hit"), (data[f.name] if isinstance(data[f.name], Column) else F.lit(data[f.name])).cast(f.type)).otherwise(c)
            elif stamp and f.name == self.model.updated_at:
                c = F.when(F.col("__hit"), F.current_timestamp().cast(f.type)).otherwise(c)
            cols.append(c.alias(f.name))
        status = F.when(F.col("__hit"), UPDATED)
        return self._change(marked.select(*cols, status.alias(_STATUS), F.lit(None).cast("long").alias(_ORDER)), name="update")

    def _deleted(self, marked: DataFrame) -> Change:
        status = F.when(F.col("__hit"), DELETED)
        return self._change(marked.select(*self.names, status.alias(_STATUS), F.lit(None).cast("long").alias(_ORDER)), name="delete")

    def delete_by_filter(self, base: Mapping[str, object] | None = None, search: object = None) -> Change:
        """Without the rows for which the filter holds; an unknown outcome keeps a row, and no filter at all deletes every row."""
        return self._deleted(self.target.alias(ROOT).withColumn("__hit", self._matching(base, search)))

    def delete_by_ids(self, ids: DataFrame | Iterable[object]) -> Change:
        """Without the rows of these ids: a DataFrame of the identity's columns, or values of a single one. Null ids delete nothing."""
        names = list(self.model.id_fields)
        if not isinstance(ids, DataFrame):
            ids = list(ids)
            if len(names) == 1 and len(ids) <= self.registry.config.list_limit:  # few enough for a predicate, which needs no join
                few = [x[0] if isinstance(x, tuple) else x for x in ids]
                return self._deleted(self.target.withColumn("__hit", F.coalesce(F.col(names[0]).isin(*[x for x in few if x is not None]), F.lit(False))))
            kind = self.target.select(*names).schema
            ids = self.target.sparkSession.createDataFrame([x if isinstance(x, tuple) else (x,) for x in ids], kind)
        gone = ids.select(*names).distinct().withColumn("__gone", F.lit(True))
        return self._deleted(self.target.join(gone, names, "left").withColumn("__hit", F.col("__gone").isNotNull()))

    def delete_cascading(self, change: Change) -> dict[str, DataFrame]:
        """Snapshots by model after a deletion and all that depends on it: rows of which a to-one target with ``cascade`` is gone.

        A row goes if any of its cascading relations says so, by whatever path, and models may refer to each other or to
        themselves. Of models that others depend on, the keys of rows that go are gathered, level by level until none is new, and
        stored; then each table is read once, without the rows that point at any of them.
        """
        registry = self.registry
        down: dict[str, list[tuple[str, RelationDef]]] = {}  # by target: models with a cascading relation to it
        for name in registry.bound():
            for r in registry.model(name).relations:
                if r.cascade and not r.is_list:
                    down.setdefault(r.target, []).append((name, r))

        def needed(name: str) -> list[str]:
            return sorted({k for _, r in down.get(name, ()) for k in r.remote})

        def keys(doomed: DataFrame, r: RelationDef) -> DataFrame:
            return doomed.select(*(F.col(k).alias(f"__{k}") for k in r.remote)).dropna().distinct()

        def match(rows: DataFrame, gone: DataFrame, r: RelationDef) -> Column:
            return _all(rows[a] == gone[f"__{b}"] for a, b in zip(r.local, r.remote))

        start = self.model.name
        doomed: dict[str, DataFrame] = {}
        level = {}
        if needed(start):
            level[start] = cut(change.marked.where(F.col(_STATUS) == DELETED).select(*needed(start)).distinct())
        while level:
            found: dict[str, DataFrame] = {}
            for parent, gone in level.items():
                doomed[parent] = doomed[parent].unionByName(gone) if parent in doomed else gone
                for name, r in down[parent]:
                    if needed(name):
                        rows = registry.df(name)
                        pointed = keys(gone, r)
                        hit = rows.join(pointed, match(rows, pointed, r), "left_semi").select(*needed(name))
                        found[name] = found[name].unionByName(hit) if name in found else hit
            level = {}
            for name, hit in found.items():
                hit = hit.distinct()
                if name in doomed:
                    old = doomed[name]
                    hit = hit.join(old, _all(hit[k].eqNullSafe(old[k]) for k in needed(name)), "left_anti")
                hit = cut(hit)
                if name not in doomed or not hit.isEmpty():
                    level[name] = hit
        out = {start: change.snapshot}
        for parent, gone in doomed.items():
            for name, r in down[parent]:
                rows = out.get(name, registry.df(name))
                pointed = keys(gone, r)
                out[name] = rows.join(pointed, match(rows, pointed, r), "left_anti")
        return out

    def apply_cascading(self, change: Change) -> dict[str, DataFrame]:
        """Stores the snapshots of ``delete_cascading``, several at once, and binds them together. Inside a transaction one by one."""
        registry, config = self.registry, self.registry.config
        with registry.metrics.timed("cascade", self.model.name):
            found = self.delete_cascading(change)
            registry.throttle()
            done, failed = in_parallel(lambda n: (n, registry.kept(found[n])), found, config.concurrency if config.parallel and not registry.in_transaction else 1)
        if failed:
            raise failed[0][1]
        for name, df in done:
            registry.bind(name, df)
        return dict(done)

    # -- one row ----------------------------------------------------------------------------------

    def create(self, values: Mapping[str, object]) -> Change:
        if not values:
            raise ValueError("no data to create")
        return self.create_many([values], skip_duplicates=False)

    def update(self, values: Mapping[str, object]) -> Change:
        if any(values.get(k) is None for k in self.model.id_fields):
            raise ValueError("an update needs the identity")
        return self.update_many_by_id([values])

    def upsert(self, values: Mapping[str, object]) -> Change:
        """By the first unique key that is complete and has a row; else an insert. All keys are looked up in one job."""
        keys = [k for k in self.model.unique_constraints() if all(values.get(c) is not None for c in k)]
        if keys:
            query = EntityQuery(self.registry, self.model.name)
            found = self.target.alias(ROOT).agg(*(F.max(F.coalesce(query.predicate({c: values[c] for c in k}), F.lit(False))).alias(f"k{i}") for i, k in enumerate(keys))).first()
            for i, key in enumerate(keys):
                if found[f"k{i}"]:
                    return self.upsert_many([values], key)
        return self.create(values)

    def delete(self, identity: object) -> Change:
        return self.delete_by_ids([identity])

    # -- links ------------------------------------------------------------------------------------

    def _link(self, name: str) -> LinkDef:
        found = self.model.link_named(name)
        if found is None:
            raise UnknownField(f"{self.model.name}.{name}")
        return found

    def apply_links(self, link: str, pairs: DataFrame) -> DataFrame:
        """The link table with these (source, target) pairs added once each; pairs with nulls and those there already add nothing.

        Times of creation are filled in where the table has such columns.
        """
        found = self._link(link)
        return add_links(self.registry.df(found.table), pairs, found.source_key, found.target_key, self.registry.model(found.table))


def add_links(table: DataFrame, pairs: DataFrame, source: str, target: str, model: ModelDef | None = None) -> DataFrame:
    fresh = pairs.select(F.col(pairs.columns[0]).cast(table.schema[source].dataType).alias(source), F.col(pairs.columns[1]).cast(table.schema[target].dataType).alias(target)).dropna().distinct()
    fresh = fresh.join(table.select(source, target), [source, target], "left_anti")
    for name in (model.created_at, model.updated_at) if model else ():
        if name in table.columns:
            fresh = fresh.withColumn(name, F.current_timestamp().cast(table.schema[name].dataType))
    return table.unionByName(fresh, allowMissingColumns=True)
