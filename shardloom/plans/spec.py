"""What a parsed query says, before it meets a table."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRef:
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Bucket:
    interval_ms: int
    column: str


@dataclass(frozen=True)
class Aggregate:
    function: str  # count, sum, avg, min, max, percentile
    column: str | None  # None is *
    p: float | None = None

    @property
    def label(self) -> str:
        kind = f"percentile({self.p * 100:g})" if self.function == "percentile" else self.function
        return f"{kind}_{self.column or '*'}"


Expression = ColumnRef | Star | Bucket | Aggregate


@dataclass(frozen=True)
class Item:
    expression: Expression
    alias: str | None = None


@dataclass(frozen=True)
class Ago:
    """NOW() less an interval."""

    interval_ms: int


Literal = int | float | str | bool | None | Ago


@dataclass(frozen=True)
class Comparison:
    column: str
    operator: str  # = != < <= > >= like, not like
    value: Literal


@dataclass(frozen=True)
class And:
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Predicate, ...]


Predicate = Comparison | And | Or


@dataclass(frozen=True)
class OrderKey:
    expression: Expression
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    table: str
    items: tuple[Item, ...]
    where: Predicate | None = None
    group_by: tuple[Expression, ...] = field(default=())
    order_by: tuple[OrderKey, ...] = field(default=())
    limit: int | None = None
