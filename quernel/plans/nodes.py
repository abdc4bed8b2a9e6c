"""The syntax tree: expressions, queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: Any
    type: str


@dataclass(frozen=True)
class Param(Expr):
    """Number from 1; ``numbered`` for $n, else a question mark."""

    number: int
    numbered: bool


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Not(Expr):
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Like(Expr):
    left: Expr
    pattern: Expr
    folded: bool
    escape: Expr | None = None


@dataclass(frozen=True)
class Is(Expr):
    operand: Expr
    what: str  # TRUE, FALSE, NULL
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class In(Expr):
    operand: Expr
    source: Expr  # a Row, a SubQuery, or a single parenthesised expression
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: Query


@dataclass(frozen=True)
class SubQuery(Expr):
    query: Query


@dataclass(frozen=True)
class Row(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Paren(Expr):
    inner: Expr


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    type: str


@dataclass(frozen=True)
class Trim(Expr):
    kind: str | None
    chars: Expr | None
    target: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class CurrentDate(Expr):
    pass


@dataclass(frozen=True)
class Star(Expr):
    qualifier: str | None = None


@dataclass(frozen=True)
class Scan:
    source: str | Query
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str  # INNER or LEFT
    scan: Scan
    on: Expr


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr, str | None], ...]
    distinct: bool = False
    scan: Scan | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[tuple[Expr, bool], ...] = ()


@dataclass(frozen=True)
class Values:
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class SetOp:
    op: str  # UNION, UNION ALL, EXCEPT
    left: Any
    right: Any


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class Query:
    body: Any  # Select, Values or SetOp
    ctes: tuple[Cte, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Statement:
    """A parsed statement; ``options`` are pairs of a name and a number or Param."""

    options: tuple[tuple[str, Any], ...] = field(default=(), kw_only=True)
    explain: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class Dql(Statement):
    query: Query


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    columns: tuple[str, ...]
    query: Query
    conflict: str = "FAIL"  # FAIL, NOTHING or REPLACE


@dataclass(frozen=True)
class Update(Statement):
    table: str
    sets: tuple[tuple[str, Expr], ...]
    source: Scan | None = None
    where: Expr | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expr | None = None
    alias: str | None = None


@dataclass(frozen=True)
class CallProc(Statement):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Empty(Statement):
    pass


@dataclass(frozen=True)
class CreateTable(Statement):
    name: str
    columns: tuple[tuple[str, str, bool], ...]  # name, type, nullable
    primary_key: tuple[str, ...]
    shard_key: tuple[str, ...] | None  # None: global
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Statement):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex(Statement):
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropIndex(Statement):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateProc(Statement):
    name: str
    types: tuple[str, ...]
    body: str
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropProc(Statement):
    name: str
    types: tuple[str, ...] | None = None
    if_exists: bool = False


@dataclass(frozen=True)
class RenameProc(Statement):
    name: str
    new_name: str


@dataclass(frozen=True)
class SetOption(Statement):
    """SET, SET TRANSACTION, ALTER SYSTEM: accepted; only a time zone has an effect."""

    time_zone: str | None = None


@dataclass(frozen=True)
class Administration(Statement):
    """Access control and plugins."""

    what: str
