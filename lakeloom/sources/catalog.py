"""Where table states live: version files of one table, and catalogs of many."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass
from threading import RLock
from typing import TYPE_CHECKING

from ..errors import NamespaceAlreadyExists, NamespaceNotEmpty, NamespaceNotFound, TableAlreadyExists, TableNotFound
from ..plans.metadata import TableMetadata
from ..plans.partition import PartitionSpec
from . import storage

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

    from ..table import Table

_VERSION = re.compile(r"v(\d+)\.metadata\.json$")
Namespace = tuple[str, ...]


class VersionStore:
    """``metadata/v{n}.metadata.json`` of a table; the highest existing version is the state."""

    def __init__(self, location: str):
        self.location = storage.normalise(location)

    def _path(self, version: int) -> str:
        return f"{self.location}/metadata/v{version}.metadata.json"

    def version(self) -> int | None:
        """The newest version: from the hint on, as a hint may lag behind."""
        hint = f"{self.location}/metadata/version-hint.text"
        n = -1
        if storage.exists(hint):
            n = int(storage.read_text(hint).strip() or -1)
        if n < 0 or not storage.exists(self._path(n)):
            found = [int(m[1]) for p, _, _ in storage.list_files(f"{self.location}/metadata") if (m := _VERSION.search(p))]
            return max(found, default=None)
        while storage.exists(self._path(n + 1)):
            n += 1
        return n

    def load(self) -> tuple[int, TableMetadata]:
        n = self.version()
        if n is None:
            raise TableNotFound(self.location)
        return n, TableMetadata.from_json(json.loads(storage.read_text(self._path(n))))

    def create(self, version: int, meta: TableMetadata) -> bool:
        """Whether this writer was the one to create the version."""
        try:
            storage.write_new(self._path(version), json.dumps(meta.to_json(), indent=1))
        except FileExistsError:
            return False
        storage.write_over(f"{self.location}/metadata/version-hint.text", str(version))
        return True


@dataclass(frozen=True)
class TableIdentifier:
    namespace: Namespace
    name: str

    @classmethod
    def parse(cls, text: str) -> TableIdentifier:
        """``a.b.t`` is table t of namespace (a, b); a single part has an empty namespace."""
        *namespace, name = text.split(".")
        return cls(tuple(namespace), name)

    def __str__(self) -> str:
        return ".".join((*self.namespace, self.name))


def _identifier(t: str | TableIdentifier) -> TableIdentifier:
    return TableIdentifier.parse(t) if isinstance(t, str) else t


def _namespace(n: str | Namespace) -> Namespace:
    return tuple(n.split(".")) if isinstance(n, str) else tuple(n)


class Catalog(ABC):
    """Namespaces and tables; subclasses keep the state and guard it."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse, self._lock = spark, storage.normalise(warehouse), RLock()

    @abstractmethod
    def _load(self) -> dict:
        """{"namespaces": {name: properties}, "tables": {name: location}}"""

    @abstractmethod
    def _save(self, state: dict) -> None: ...

    def list_namespaces(self, parent: str | Namespace | None = None) -> list[Namespace]:
        """Without a parent the single-level ones, else those exactly one level below it."""
        up = _namespace(parent) if parent is not None else ()
        return sorted(n for n in (tuple(k.split(".")) for k in self._load()["namespaces"]) if n[: len(up)] == up and len(n) == len(up) + 1)

    def create_namespace(self, namespace: str | Namespace, properties: dict[str, str] | None = None) -> None:
        with self._lock:
            state, key = self._load(), ".".join(_namespace(namespace))
            if key in state["namespaces"]:
                raise NamespaceAlreadyExists(key)
            state["namespaces"][key] = dict(properties or {})
            self._save(state)

    def drop_namespace(self, namespace: str | Namespace) -> None:
        with self._lock:
            state, key = self._load(), ".".join(_namespace(namespace))
            if key not in state["namespaces"]:
                raise NamespaceNotFound(key)
            inside = [t for t in state["tables"] if t.rpartition(".")[0] == key] + [n for n in state["namespaces"] if n.startswith(key + ".")]
            if inside:
                raise NamespaceNotEmpty(f"{key} holds {inside[0]}")
            del state["namespaces"][key]
            self._save(state)

    def namespace_properties(self, namespace: str | Namespace) -> dict[str, str]:
        key = ".".join(_namespace(namespace))
        found = self._load()["namespaces"].get(key)
        if found is None:
            raise NamespaceNotFound(key)
        return dict(found)

    def list_tables(self, namespace: str | Namespace) -> list[TableIdentifier]:
        want = _namespace(namespace) if namespace else ()
        return sorted((t for t in map(TableIdentifier.parse, self._load()["tables"]) if t.namespace == want), key=str)

    def create_table(self, table: str | TableIdentifier, schema, spec: PartitionSpec | None = None, properties: dict[str, str] | None = None, location: str | None = None) -> Table:
        """Creates a table; its namespace is created along with it."""
        from ..table import create_table

        own = _identifier(table)
        with self._lock:
            state = self._load()
            if str(own) in state["tables"]:
                raise TableAlreadyExists(str(own))
            at = location or "/".join((self.warehouse, *own.namespace, own.name))
            made = create_table(self.spark, at, schema, spec, properties)
            for k in range(1, len(own.namespace) + 1):
                state["namespaces"].setdefault(".".join(own.namespace[:k]), {})
            state["tables"][str(own)] = storage.normalise(at)
            self._save(state)
        made.identifier = own
        return made

    def load_table(self, table: str | TableIdentifier) -> Table:
        from ..table import open_table

        own = _identifier(table)
        at = self._load()["tables"].get(str(own))
        if at is None:
            raise TableNotFound(str(own))
        found = open_table(self.spark, at)
        found.identifier = own
        return found

    def drop_table(self, table: str | TableIdentifier, purge: bool = False) -> None:
        """Forgets a table; ``purge`` removes its files."""
        own = str(_identifier(table))
        with self._lock:
            state = self._load()
            if own not in state["tables"]:
                raise TableNotFound(own)
            at = state["tables"].pop(own)
            self._save(state)
        if purge:
            storage.delete(at)

    def rename_table(self, old: str | TableIdentifier, new: str | TableIdentifier) -> None:
        a, b = str(_identifier(old)), str(_identifier(new))
        with self._lock:
            state = self._load()
            if a not in state["tables"]:
                raise TableNotFound(a)
            if b in state["tables"]:
                raise TableAlreadyExists(b)
            state["tables"][b] = state["tables"].pop(a)
            self._save(state)

    def table_exists(self, table: str | TableIdentifier) -> bool:
        return str(_identifier(table)) in self._load()["tables"]


class InMemoryCatalog(Catalog):
    """A catalog that lives as long as the process; table data is in the warehouse folder."""

    def __init__(self, spark: SparkSession, warehouse: str):
        super().__init__(spark, warehouse)
        self._state: dict = {"namespaces": {}, "tables": {}}

    def _load(self) -> dict:
        return {k: dict(v) for k, v in self._state.items()}

    def _save(self, state: dict) -> None:
        self._state = state


class FileCatalog(Catalog):
    """A catalog kept as numbered JSON files in the warehouse; the exclusive create of the next number guards changes."""

    def _numbers(self) -> list[int]:
        return [int(m[1]) for p, _, _ in storage.list_files(f"{self.warehouse}/_catalog") if (m := re.search(r"c(\d+)\.json$", p))]

    def _load(self) -> dict:
        n = max(self._numbers(), default=None)
        state = json.loads(storage.read_text(f"{self.warehouse}/_catalog/c{n}.json")) if n is not None else {"namespaces": {}, "tables": {}}
        return state | {"version": -1 if n is None else n}

    def _save(self, state: dict) -> None:
        n = state.pop("version") + 1
        storage.write_new(f"{self.warehouse}/_catalog/c{n}.json", json.dumps(state, indent=1))
