"""One row of a model as an object: its fields as attributes, written by the set-based mutations."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Row

from .functions.compare import has_changes
from .functions.rows import sanitize_keys
from .model import Registry, UnknownField
from .operators.mutate import Mutations
from .operators.query import EntityQuery


def plain(value: object) -> object:
    """Rows, mappings and lists as plain dicts and lists."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def _json(value: object) -> object:
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat(timespec="milliseconds") + "Z"
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    raise TypeError(type(value).__name__)


class Entity:
    """Values of a model's fields, relations and links. Only names that were given or set count; None is a value like any other.

    Leading underscores of names are dropped. Unknown names raise.
    """

    def __init__(self, registry: Registry, name: str, values: Mapping[str, object] | Row | None = None):
        object.__setattr__(self, "_registry", registry)
        object.__setattr__(self, "_model", registry.model(name))
        object.__setattr__(self, "_values", {})
        for k, v in sanitize_keys(plain(values or {})).items():
            setattr(self, k, v)

    def _known(self, name: str) -> bool:
        m = self._model
        return m.field_named(name) is not None or m.relation_named(name) is not None or m.link_named(name) is not None

    def __getattr__(self, name: str) -> object:
        if name in self._values:
            return self._values[name]
        if self._known(name):
            return None
        raise AttributeError(name)

    def __setattr__(self, name: str, value: object) -> None:
        if not self._known(name):
            raise UnknownField(f"{self._model.name}.{name}")
        self._values[name] = value

    def to_object(self) -> dict[str, object]:
        """The values by name, as plain dicts and lists all the way down."""
        return plain(self._values)

    def to_json(self) -> str:
        """The same as JSON: times in UTC with milliseconds, decimals as numbers, bytes in base 64."""
        return json.dumps(self.to_object(), default=_json, ensure_ascii=False)

    def _mutations(self) -> Mutations:
        return Mutations(self._registry, self._model.name)

    def _refresh(self) -> Entity:
        """Takes over what is stored under the identity, or under the first complete unique key."""
        for key in (self._model.id_fields, *self._model.unique_constraints()):
            if key and all(self._values.get(k) is not None for k in key):
                found = EntityQuery(self._registry, self._model.name).only_one({k: self._values[k] for k in key})
                if found is not None:
                    self._values.update(plain(found))
                    return self
        return self

    def create(self) -> Entity:
        m = self._mutations()
        m.apply(m.create(self._values))
        return self._refresh()

    def update(self) -> Entity:
        m = self._mutations()
        m.apply(m.update(self._values))
        return self._refresh()

    def upsert(self) -> Entity:
        """Updates the row that a complete unique key finds, if something differs after normalisation, or creates one."""
        found = EntityQuery(self._registry, self._model.name).probe(self._values)
        if found is None:
            return self.create()
        links = {x.name for x in self._model.links}
        if has_changes({k: v for k, v in self._values.items() if k not in links}, plain(found)) or links & self._values.keys():
            m = self._mutations()
            m.apply(m.upsert({**self._values, **{k: found[k] for k in self._model.id_fields}}))
        else:
            self._values.update(plain(found))
            return self
        return self._refresh()

    def delete(self) -> object:
        """Deletes the row and returns its identity."""
        identity = tuple(self._values.get(k) for k in self._model.id_fields)
        if None in identity:
            raise ValueError("a deletion needs the identity")
        m = self._mutations()
        m.apply(m.delete(identity))
        return identity if len(identity) > 1 else identity[0]
