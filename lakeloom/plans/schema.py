"""Versioned schemas: fields are told apart by immutable ids, types have one JSON form.

A type is a dict with a ``type`` tag: primitives (``boolean int long float double
date time string uuid binary``), ``timestamp`` with ``with-timezone``, ``fixed``
with ``length``, ``decimal`` with ``precision`` and ``scale``, and the nested
``struct`` (``fields``), ``list`` (``element-id``, ``element-required``,
``element``) and ``map`` (ids and types of key and value).  Spark has no column
type for time, uuid and fixed in Parquet: they are stored as long (microseconds
of the day), string and binary, and keep their tag here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import IncompatibleSchema, SchemaMismatch

FIELD_ID = "parquet.field.id"
PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}
WIDER = {("int", "long"), ("float", "double")}


def simple(name: str, **more: Any) -> dict:
    """A type by its tag, e.g. ``simple("decimal", precision=10, scale=2)``."""
    if name not in PRIMITIVES and name not in ("timestamp", "fixed", "decimal"):
        raise SchemaMismatch(f"unknown type {name}")
    out = {"type": name} | {k.replace("_", "-"): v for k, v in more.items()}
    if name == "timestamp":
        out.setdefault("with-timezone", False)
    return out


def is_nested(kind: dict) -> bool:
    return kind["type"] in ("struct", "list", "map")


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: dict
    required: bool = False
    doc: str | None = None
    default: Any = None

    def to_json(self) -> dict:
        out = {"id": self.id, "name": self.name, "required": self.required, "type": type_to_json(self.type)}
        return out | ({"doc": self.doc} if self.doc else {}) | ({"default": self.default} if self.default is not None else {})

    @classmethod
    def from_json(cls, j: dict) -> Field:
        return cls(j["id"], j["name"], type_from_json(j["type"]), j["required"], j.get("doc"), j.get("default"))


def type_to_json(kind: dict) -> dict:
    if kind["type"] == "struct":
        return {"type": "struct", "fields": [f.to_json() for f in kind["fields"]]}
    return {k: type_to_json(v) if isinstance(v, dict) else v for k, v in kind.items()}


def type_from_json(j: dict) -> dict:
    if j["type"] == "struct":
        return {"type": "struct", "fields": [Field.from_json(f) for f in j["fields"]]}
    return {k: type_from_json(v) if isinstance(v, dict) else v for k, v in j.items()}


def spark_type(kind: dict) -> T.DataType:
    tag = kind["type"]
    if tag in PRIMITIVES:
        return PRIMITIVES[tag]
    if tag == "timestamp":
        return T.TimestampType() if kind["with-timezone"] else T.TimestampNTZType()
    if tag == "fixed":
        return T.BinaryType()
    if tag == "decimal":
        return T.DecimalType(kind["precision"], kind["scale"])
    if tag == "struct":
        return T.StructType([spark_field(f) for f in kind["fields"]])
    if tag == "list":
        return T.ArrayType(spark_type(kind["element"]), not kind["element-required"])
    return T.MapType(spark_type(kind["key"]), spark_type(kind["value"]), not kind["value-required"])


def spark_field(f: Field) -> T.StructField:
    return T.StructField(f.name, spark_type(f.type), True, {FIELD_ID: f.id})


class Ids:
    """Hands out field ids."""

    def __init__(self, last: int = 0):
        self.last = last

    def __call__(self) -> int:
        self.last += 1
        return self.last


def type_of_spark(t: T.DataType, ids: Ids) -> dict:
    """Our form of a Spark type; nested fields get fresh ids."""
    for tag in ("boolean", "int", "long", "float", "double", "date", "string", "binary"):
        if t == PRIMITIVES[tag]:
            return {"type": tag}
    if isinstance(t, T.TimestampType):
        return simple("timestamp", with_timezone=True)
    if isinstance(t, T.TimestampNTZType):
        return simple("timestamp", with_timezone=False)
    if isinstance(t, T.DecimalType):
        return simple("decimal", precision=t.precision, scale=t.scale)
    if isinstance(t, T.StructType):
        return {"type": "struct", "fields": [Field(ids(), f.name, type_of_spark(f.dataType, ids), not f.nullable) for f in t]}
    if isinstance(t, T.ArrayType):
        return {"type": "list", "element-id": ids(), "element-required": not t.containsNull, "element": type_of_spark(t.elementType, ids)}
    if isinstance(t, T.MapType):
        return {"type": "map", "key-id": ids(), "key": type_of_spark(t.keyType, ids), "value-id": ids(), "value-required": not t.valueContainsNull, "value": type_of_spark(t.valueType, ids)}
    if isinstance(t, (T.ShortType, T.ByteType)):
        return {"type": "int"}
    raise SchemaMismatch(f"{t.simpleString()} has no table type")


def ids_in(kind: dict) -> Iterator[int]:
    for k, v in kind.items():
        if k.endswith("-id"):
            yield v
        elif k == "fields":
            for f in v:
                yield f.id
                yield from ids_in(f.type)
        elif isinstance(v, dict):
            yield from ids_in(v)


def with_fresh_ids(kind: dict, ids: Ids) -> dict:
    """The type with new ids for everything nested in it."""
    out = {}
    for k, v in kind.items():
        if k.endswith("-id"):
            out[k] = ids()
        elif k == "fields":
            out[k] = [replace(f, id=ids(), type=with_fresh_ids(f.type, ids)) for f in v]
        else:
            out[k] = with_fresh_ids(v, ids) if isinstance(v, dict) else v
    return out


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = ()
    schema_id: int = 0
    identifier_field_ids: tuple[int, ...] = ()

    @classmethod
    def of(cls, spec: T.StructType, identifiers: tuple[str, ...] | list[str] = (), required: tuple[str, ...] | list[str] | None = None) -> Schema:
        """From a Spark schema: ids by position, nested ones after all top-level ids."""
        ids = Ids(len(spec.fields))
        need = {f.name for f in spec if not f.nullable} if required is None else set(required)
        fields = tuple(Field(i + 1, f.name, type_of_spark(f.dataType, ids), f.name in need) for i, f in enumerate(spec))
        by_name = {f.name: f.id for f in fields}
        return cls(fields, 0, tuple(by_name[n] for n in identifiers))

    @classmethod
    def from_json(cls, j: dict) -> Schema:
        return cls(tuple(map(Field.from_json, j["fields"])), j["schema-id"], tuple(j.get("identifier-field-ids", ())))

    def to_json(self) -> dict:
        return {"schema-id": self.schema_id, "identifier-field-ids": list(self.identifier_field_ids), "fields": [f.to_json() for f in self.fields]}

    def spark(self) -> T.StructType:
        return T.StructType([spark_field(f) for f in self.fields])

    def all_fields(self) -> Iterator[tuple[str, Field]]:
        """(dotted name, field), nested struct fields included; list and map contents as ``element``, ``key``, ``value``."""

        def inside(prefix: str, kind: dict) -> Iterator[tuple[str, Field]]:
            for f in kind.get("fields", ()):
                yield prefix + f.name, f
                yield from inside(f"{prefix}{f.name}.", f.type)
            for k in ("element", "key", "value"):
                if k in kind:
                    yield from inside(f"{prefix}{k}.", kind[k])

        yield from inside("", {"fields": self.fields})

    def find(self, key: int | str) -> Field | None:
        """A field, at any depth, by id or dotted name."""
        return next((f for name, f in self.all_fields() if (f.id == key if isinstance(key, int) else name == key)), None)

    def need(self, key: int | str) -> Field:
        found = self.find(key)
        if found is None:
            raise SchemaMismatch(f"no field {key}")
        return found

    def highest_id(self) -> int:
        return max([0, *ids_in({"fields": self.fields})])

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def identifiers(self) -> list[str]:
        return [self.need(i).name for i in self.identifier_field_ids]

    def field(self, name: str) -> Field:
        return self.need(name)

    def __len__(self) -> int:
        return len(self.fields)


class SchemaBuilder:
    """Fields one by one: ``SchemaBuilder().with_field(1, "id", simple("long"), required=True).build()``."""

    def __init__(self, schema_id: int = 0):
        self._fields: list[Field] = []
        self._schema_id, self._identifiers = schema_id, ()

    def with_field(self, id: int, name: str, kind: dict, required: bool = False, doc: str | None = None, default: Any = None) -> SchemaBuilder:
        self._fields.append(Field(id, name, kind, required, doc, default))
        return self

    def with_identifiers(self, *ids: int) -> SchemaBuilder:
        self._identifiers = ids
        return self

    def build(self) -> Schema:
        return Schema(tuple(self._fields), self._schema_id, self._identifiers)


@dataclass
class SchemaUpdate:
    """A list of changes, applied in order to a new schema version."""

    base: Schema
    last_id: int
    changes: list[tuple] = field(default_factory=list)

    def add_column(self, name: str, kind: dict, parent: int | str | None = None, doc: str | None = None) -> SchemaUpdate:
        self.changes.append(("add", parent, name, kind, doc))
        return self

    def drop_column(self, key: int | str) -> SchemaUpdate:
        self.changes.append(("drop", key))
        return self

    def rename_column(self, key: int | str, name: str) -> SchemaUpdate:
        self.changes.append(("rename", key, name))
        return self

    def widen_type(self, key: int | str, kind: dict) -> SchemaUpdate:
        self.changes.append(("widen", key, kind))
        return self

    def make_optional(self, key: int | str) -> SchemaUpdate:
        self.changes.append(("optional", key))
        return self

    def apply(self, schema_id: int) -> Schema:
        """The new schema; ids count on from ``last_id``, which is raised."""
        ids = Ids(max(self.last_id, self.base.highest_id()))
        now = replace(self.base, schema_id=schema_id)
        for what, key, *more in self.changes:
            target = None if key is None else now.find(key)
            if key is not None and target is None:
                if what == "drop":
                    continue  # dropping what isn't there changes nothing
                raise SchemaMismatch(f"no field {key}")
            root = {"type": "struct", "fields": list(now.fields)}
            if what == "add":
                name, kind, doc = more
                if target is not None and target.type["type"] != "struct":
                    raise SchemaMismatch(f"{target.name} is no struct")
                fresh = Field(ids(), name, with_fresh_ids(kind, ids), False, doc)
                root = _edit(root, None if target is None else target.id, lambda f: _with_child(f, fresh))
            elif what == "drop":
                root = _drop(root, target.id)
            elif what == "rename":
                root = _edit(root, target.id, lambda f: replace(f, name=more[0]))
            elif what == "widen":
                pair = (target.type["type"], more[0]["type"])
                if pair not in WIDER and not _wider_decimal(target.type, more[0]):
                    raise IncompatibleSchema(f"{target.name}: {pair[0]} cannot become {pair[1]}")
                root = _edit(root, target.id, lambda f: replace(f, type=more[0]))
            else:
                root = _edit(root, target.id, lambda f: replace(f, required=False))
            _check_names(root)
            left = set(ids_in(root))
            now = Schema(tuple(root["fields"]), schema_id, tuple(i for i in now.identifier_field_ids if i in left))
        self.last_id = ids.last
        return now


def _wider_decimal(a: dict, b: dict) -> bool:
    return a["type"] == b["type"] == "decimal" and a["scale"] == b["scale"] and a["precision"] <= b["precision"]


def _with_child(f: Field | dict, child: Field):
    if isinstance(f, dict):
        return f | {"fields": [*f["fields"], child]}
    return replace(f, type=f.type | {"fields": [*f.type["fields"], child]})


def _edit(kind: dict, id: int | None, change) -> dict:
    """The type with the field of that id changed; None: the root struct itself."""
    if id is None:
        return change(kind)
    out = dict(kind)
    if "fields" in kind:
        out["fields"] = [change(f) if f.id == id else replace(f, type=_edit(f.type, id, change)) for f in kind["fields"]]
    for k in ("element", "key", "value"):
        if k in kind:
            out[k] = _edit(kind[k], id, change)
    return out


def _drop(kind: dict, id: int) -> dict:
    out = dict(kind)
    if "fields" in kind:
        out["fields"] = [replace(f, type=_drop(f.type, id)) for f in kind["fields"] if f.id != id]
    for k in ("element", "key", "value"):
        if k in kind:
            out[k] = _drop(kind[k], id)
    return out


def _check_names(kind: dict) -> None:
    names = [f.name for f in kind.get("fields", ())]
    if len(names) != len(set(names)):
        raise SchemaMismatch(f"a name occurs twice in {names}")
    for f in kind.get("fields", ()):
        _check_names(f.type)


def check_compatible(old: Schema, new: Schema) -> None:
    """Raises IncompatibleSchema unless data of ``old`` reads under ``new``: only widening, nothing newly required."""

    def fields(a: list[Field] | tuple, b: list[Field] | tuple, where: str) -> None:
        before = {f.id: f for f in a}
        for f in b:
            was = before.get(f.id)
            if was is None:
                if f.required:
                    raise IncompatibleSchema(f"{where}{f.name}: a new column must be optional")
            else:
                if f.required and not was.required:
                    raise IncompatibleSchema(f"{where}{f.name}: an optional column cannot become required")
                kinds(was.type, f.type, f"{where}{f.name}.")

    def kinds(a: dict, b: dict, where: str) -> None:
        if a["type"] == b["type"] == "struct":
            fields(a["fields"], b["fields"], where)
        elif a["type"] == b["type"] and a["type"] in ("list", "map"):
            for k in ("element", "key", "value"):
                if k in a:
                    kinds(a[k], b[k], f"{where}{k}.")
            for k in ("element-required", "value-required"):
                if b.get(k) and not a.get(k):
                    raise IncompatibleSchema(f"{where[:-1]}: contents cannot become required")
        elif a != b and (a["type"], b["type"]) not in WIDER and not _wider_decimal(a, b):
            raise IncompatibleSchema(f"{where[:-1]}: {a['type']} cannot become {b['type']}")

    fields(old.fields, new.fields, "")
