"""Models: named record types with fields, relations, links and keys, and the registry that binds them to DataFrames."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime.control import EngineConfig, TokenBucket, with_retry
from .runtime.lineage import cut
from .runtime.metrics import Metrics
from .sources.tables import write_snapshot


class UnknownModel(KeyError):
    pass


class UnknownField(KeyError):
    pass


@dataclass(frozen=True)
class FieldDef:
    """A column. ``kind`` is scalar, enum, json (text that holds JSON) or embedded (a struct, or an array of structs)."""

    name: str
    type: T.DataType
    kind: str = "scalar"
    required: bool = False
    unique: bool = False
    is_id: bool = False
    has_default: bool = False
    default: object = None
    column: str | None = None
    values: tuple[str, ...] = ()

    @property
    def is_list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def physical(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class RelationDef:
    """``local`` columns of this model equal ``remote`` ones of ``target``. Rows go with their to-one target if ``cascade``."""

    name: str
    target: str
    local: tuple[str, ...]
    remote: tuple[str, ...]
    is_list: bool = False
    cascade: bool = False
    through: LinkDef | None = None


@dataclass(frozen=True)
class LinkDef:
    """Many to many over the model ``table``, whose columns point at this model's id and the target's."""

    name: str
    target: str
    table: str
    source_key: str
    target_key: str


@dataclass(frozen=True)
class ModelDef:
    name: str
    fields: tuple[FieldDef, ...]
    relations: tuple[RelationDef, ...] = ()
    links: tuple[LinkDef, ...] = ()
    unique_groups: tuple[tuple[str, ...], ...] = ()
    unique_indexes: tuple[tuple[str, ...], ...] = ()
    primary_key: tuple[str, ...] = ()
    created_at: str = "createdAt"
    updated_at: str = "updatedAt"

    def field_named(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    def relation_named(self, name: str) -> RelationDef | None:
        return next((r for r in self.relations if r.name == name), None)

    def link_named(self, name: str) -> LinkDef | None:
        return next((x for x in self.links if x.name == name), None)

    @property
    def id_fields(self) -> tuple[str, ...]:
        """The identity: the primary key, else the id field, else the first unique constraint."""
        own = tuple(f.name for f in self.fields if f.is_id)
        return self.primary_key or own or next(iter(self.unique_constraints()), ())

    def unique_constraints(self) -> list[tuple[str, ...]]:
        """Groups, indexes, single unique fields, a key that isn't the plain id; the id itself only where there is nothing else."""
        own = tuple(f.name for f in self.fields if f.is_id)
        found = [*self.unique_groups, *self.unique_indexes, *((f.name,) for f in self.fields if f.unique and not f.is_id)]
        if self.primary_key and self.primary_key != own:
            found.append(self.primary_key)
        out: list[tuple[str, ...]] = []
        for key in found:
            if key not in out:
                out.append(key)
        return out or ([own] if own else [])

    def json_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.kind == "json"]

    def scalar_list_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.is_list and f.kind != "embedded"]

    @classmethod
    def of_schema(cls, name: str, schema: T.StructType, key: Iterable[str] = (), json: Iterable[str] = (), required: Iterable[str] = (), unique: Iterable[str] = (), **rest: object) -> ModelDef:
        """A model of a DataFrame's schema. Parquet says of every column that it may be null, so ``required`` is stated."""
        key, json, required, unique = tuple(key), set(json), set(required), set(unique)
        fields = []
        for f in schema:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            kind = "json" if f.name in json else "embedded" if isinstance(inner, T.StructType) else "scalar"
            fields.append(FieldDef(f.name, f.dataType, kind, f.name in required or f.name in key, f.name in unique, key == (f.name,)))
        return cls(name, tuple(fields), primary_key=key, **rest)


class TransactionConflict(RuntimeError):
    """Another transaction has published a table that this one wrote too."""


#: The open transaction's own snapshots, by registry; other threads don't see them.
_OPEN: ContextVar[Mapping[int, dict[str, DataFrame]]] = ContextVar("open_transactions", default={})


@dataclass
class Registry:
    """Models by name, each bound to its current snapshot. Snapshots are immutable; mutations bind new ones."""

    models: dict[str, ModelDef] = field(default_factory=dict)
    snapshots: dict[str, DataFrame] = field(default_factory=dict)
    config: EngineConfig = field(default_factory=EngineConfig)
    metrics: Metrics = field(default_factory=Metrics)

    def __post_init__(self) -> None:
        self._publishing = threading.Lock()
        self._bucket = TokenBucket(self.config.max_queries_per_second)

    def throttle(self) -> None:
        """Waits until another action may start."""
        self._bucket.acquire()

    def kept(self, df: DataFrame) -> DataFrame:
        """df computed once and written where all executors can read it; attempts are repeated where an error may pass."""

        def write() -> DataFrame:
            folder = self.config.snapshot_folder
            return df.sparkSession.read.parquet(write_snapshot(df, folder)) if folder else cut(df)

        return with_retry(write, self.config.retries)

    def add(self, model: ModelDef, df: DataFrame | None = None) -> Registry:
        self.models[model.name] = model
        if df is not None:
            self.bind(model.name, df)
        return self

    def bind(self, name: str, df: DataFrame) -> None:
        """Takes physical or logical column names; snapshots carry logical ones. Inside a transaction only that sees it yet."""
        model = self.model(name)
        renames = {f.physical: f.name for f in model.fields if f.physical != f.name and f.physical in df.columns}
        df = df.withColumnsRenamed(renames) if renames else df
        own = _OPEN.get().get(id(self))
        if own is not None:
            own[name] = df
        else:
            self.snapshots = {**self.snapshots, name: df}

    @property
    def in_transaction(self) -> bool:
        return id(self) in _OPEN.get()

    @contextmanager
    def transaction(self) -> Iterator[Registry]:
        """Snapshots bound inside are seen inside, and by all others at once when the block ends; an exception drops them.

        Transactions don't nest. Of two that wrote the same table the one that ends later raises ``TransactionConflict``, and
        nothing of it is published.
        """
        if self.in_transaction:
            raise RuntimeError("transactions don't nest")
        own: dict[str, DataFrame] = {}
        base = self.snapshots
        token = _OPEN.set({**_OPEN.get(), id(self): own})
        try:
            yield self
        finally:
            _OPEN.reset(token)
        with self._publishing:
            changed = [n for n in own if self.snapshots.get(n) is not base.get(n)]
            if changed:
                raise TransactionConflict(f"published by others since this transaction began: {changed}")
            self.snapshots = {**self.snapshots, **own}

    def model(self, name: str) -> ModelDef:
        if name not in self.models:
            raise UnknownModel(name)
        return self.models[name]

    def df(self, name: str) -> DataFrame:
        self.model(name)
        own = _OPEN.get().get(id(self), {})
        if name not in own and name not in self.snapshots:
            raise UnknownModel(f"{name} has no data")
        return own[name] if name in own else self.snapshots[name]

    def bound(self) -> list[str]:
        """Models that have data."""
        return [n for n in self.models if n in self.snapshots or n in _OPEN.get().get(id(self), {})]

    def physical(self, name: str) -> DataFrame:
        """The snapshot under the names that storage uses."""
        return self.df(name).withColumnsRenamed({f.name: f.physical for f in self.model(name).fields})

    def names(self) -> list[str]:
        return list(self.models)

    def rows(self, name: str, items: Iterable[Mapping[str, object]]) -> DataFrame:
        """Plain dicts as a DataFrame of the model's columns and ``_present``, the names that each dict has, and ``_ord``."""
        model = self.model(name)
        items = [dict(x) for x in items]
        schema = T.StructType([T.StructField(f.name, f.type) for f in model.fields] + [T.StructField("_present", T.ArrayType(T.StringType())), T.StructField("_ord", T.LongType())])
        names = [f.name for f in model.fields]
        for x in items:
            unknown = set(x) - set(names)
            if unknown:
                raise UnknownField(f"{name}: {sorted(unknown)}")
        data = [tuple(x.get(n) for n in names) + ([n for n in names if n in x], i) for i, x in enumerate(items)]
        return self.df(name).sparkSession.createDataFrame(data, schema)


def require(model: ModelDef, names: Iterable[str]) -> None:
    for n in names:
        if model.field_named(n) is None:
            raise UnknownField(f"{model.name}.{n}")
