"""Tables with what Spark's catalog doesn't keep: keys, kind, nullability; functions and procedures."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..plans import nodes as n
from .storage import dialect_type


MOST_PARTS = 16


@dataclass(frozen=True)
class Table:
    """columns: (name, type, nullable). shard_key: None for a global table."""

    name: str
    view: str
    columns: tuple[tuple[str, str, bool], ...]
    primary_key: tuple[str, ...] = ()
    shard_key: tuple[str, ...] | None = None
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    frame: DataFrame | None = None
    #: Inserts whose files lie beside the state's; at MOST_PARTS all are written as one.
    parts: int = 0

    def with_frame(self, frame: DataFrame) -> Table:
        frame.createOrReplaceTempView(self.view)
        return replace(self, frame=frame)


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, tuple[str, str]] = {}
        self.procedures: dict[str, n.CreateProc] = {}

    def has(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"no such table: {name}")
        return self.tables[name]

    def put(self, name: str, frame: DataFrame, *, primary_key: tuple[str, ...] = (), shard_key: tuple[str, ...] | None = None, columns: tuple[tuple[str, str, bool], ...] | None = None) -> Table:
        """Registers a DataFrame; the types of its columns are the dialect's counterparts unless they are given."""
        found = columns or tuple((f.name, dialect_type(f.dataType), f.nullable and f.name not in primary_key) for f in frame.schema.fields)
        names = [c for c, _, _ in found]
        if len(set(names)) < len(names):
            raise QueryError(f"the table {name!r} has two columns of one name")
        for c in (*primary_key, *(shard_key or ())):
            if c not in names:
                raise QueryError(f"no such column in the key: {c}")
        self.tables[name] = Table(name, name, found, tuple(primary_key), tuple(shard_key) if shard_key else None).with_frame(frame)
        return self.tables[name]

    def change(self, name: str, frame: DataFrame, *, parts: int = 0) -> None:
        self.tables[name] = replace(self.table(name).with_frame(frame), parts=parts)
