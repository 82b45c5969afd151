"""The contract itself: plain data, no Spark session needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from siltworks.functions.coercion import KINDS


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"field {self.name}: unknown kind {self.kind!r}, use one of {sorted(KINDS)}")


@dataclass(frozen=True)
class Check:
    """A rule over the typed columns, as a SQL predicate. Null counts as passed."""

    name: str
    predicate: str


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    checks: tuple[Check, ...] = ()

    @classmethod
    def of(cls, name: str, /, *checks: Check, **kinds: str) -> Contract:
        """``Contract.of("Sale", sale_id="int", note="str?")``; ``?`` marks a nullable field."""
        fields = tuple(Field(n, k.rstrip("?"), k.endswith("?")) for n, k in kinds.items())
        return cls(name, fields, checks)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS[f.kind], f.nullable) for f in self.fields])

    @property
    def landing_schema(self) -> T.StructType:
        """All text: read a file with this so that no inference pass is needed."""
        return T.StructType([T.StructField(f.name, T.StringType()) for f in self.fields])
