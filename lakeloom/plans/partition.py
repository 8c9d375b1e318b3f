"""Hidden partitioning: specs derive partition values from columns; queries never name them."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ValidationError
from ..functions import transforms
from .schema import Schema

FIRST_FIELD_ID = 1000


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: str

    def to_json(self) -> dict:
        return {"source-id": self.source_id, "field-id": self.field_id, "name": self.name, "transform": self.transform}

    @classmethod
    def from_json(cls, j: dict) -> PartitionField:
        return cls(j["source-id"], j["field-id"], j["name"], j["transform"])


@dataclass(frozen=True)
class PartitionSpec:
    spec_id: int = 0
    fields: tuple[PartitionField, ...] = ()

    def to_json(self) -> dict:
        return {"spec-id": self.spec_id, "fields": [f.to_json() for f in self.fields]}

    @classmethod
    def from_json(cls, j: dict) -> PartitionSpec:
        return cls(j["spec-id"], tuple(map(PartitionField.from_json, j["fields"])))

    @property
    def partitioned(self) -> bool:
        return bool(self.fields)


class SpecBuilder:
    """``SpecBuilder(schema).day("ts").bucket("id", 16).build()``; names follow the transform unless given."""

    def __init__(self, schema: Schema, spec_id: int = 0, first_field_id: int = FIRST_FIELD_ID):
        self._schema, self._spec_id, self._next = schema, spec_id, first_field_id
        self._fields: list[PartitionField] = []

    def add(self, column: str, transform: str, name: str | None = None) -> SpecBuilder:
        source = self._schema.need(column)
        transforms.check_source(transform, source.type)
        kind, n = transforms.parse(transform)
        flat = column.replace(".", "_")
        default = {"identity": flat, "bucket": f"{flat}_bucket_{n}", "truncate": f"{flat}_trunc_{n}"}.get(kind, f"{flat}_{kind}")
        name = name or default
        if any(f.name == name for f in self._fields):
            raise ValidationError(f"two partition fields are named {name}")
        self._fields.append(PartitionField(source.id, self._next, name, transform))
        self._next += 1
        return self

    def identity(self, column: str) -> SpecBuilder:
        return self.add(column, "identity")

    def bucket(self, column: str, n: int) -> SpecBuilder:
        return self.add(column, f"bucket[{n}]")

    def truncate(self, column: str, width: int) -> SpecBuilder:
        return self.add(column, f"truncate[{width}]")

    def year(self, column: str) -> SpecBuilder:
        return self.add(column, "year")

    def month(self, column: str) -> SpecBuilder:
        return self.add(column, "month")

    def day(self, column: str) -> SpecBuilder:
        return self.add(column, "day")

    def hour(self, column: str) -> SpecBuilder:
        return self.add(column, "hour")

    def void(self, column: str) -> SpecBuilder:
        return self.add(column, "void")

    def build(self) -> PartitionSpec:
        return PartitionSpec(self._spec_id, tuple(self._fields))
