"""Exceptions, by the layer that raises them."""

from __future__ import annotations


class ShardloomError(Exception):
    """Base of all errors; ``status`` is the HTTP status an outer shell would answer with."""

    status = 500


class ParseError(ShardloomError):
    """A query that the strict dialect refuses; ``says`` is what is wrong, ``detail`` the part of it that is meant."""

    status = 400
    says = "this is not a query of the dialect"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.says} ({detail})" if detail else self.says)
        self.detail = detail


# what is asked for as a whole


class EmptyQuery(ParseError):
    says = "there is nothing to run"


class SyntaxProblem(ParseError):
    says = "the text cannot be read as SQL"


class MultipleStatements(ParseError):
    says = "one statement at a time, please"


class UnsupportedStatement(ParseError):
    says = "only SELECT reads a table here"


class UnsupportedQuery(ParseError):
    says = "the strict dialect has no such clause; sql_extended() may"


# where rows come from


class MissingTable(ParseError):
    says = "FROM must name a table"


class JoinsNotSupported(ParseError):
    says = "a strict query reads one table; sql_extended() joins"


class UnsupportedTableExpression(ParseError):
    says = "FROM takes a table's name alone"


# what is selected, grouped and ordered


class UnsupportedProjection(ParseError):
    says = "this cannot stand in a SELECT list"


class UnsupportedFunction(ParseError):
    says = "no function of that name"


class InvalidTimeBucket(ParseError):
    says = "TIME_BUCKET takes '<count> <unit>' and a column"


class InvalidInterval(ParseError):
    says = "not a length of time"


class UnsupportedGroupByExpression(ParseError):
    says = "GROUP BY takes columns, aliases and TIME_BUCKET"


class UnsupportedOrderByExpression(ParseError):
    says = "ORDER BY takes columns, aliases and aggregates, ASC or DESC"


class InvalidLimit(ParseError):
    says = "LIMIT takes a whole number that is not negative"


# conditions


class UnsupportedExpression(ParseError):
    says = "conditions compare a column with a literal"


class UnsupportedOperator(ParseError):
    says = "no such operator in conditions"


class ExpectedColumnName(ParseError):
    says = "a column belongs on the left"


class ExpectedValue(ParseError):
    says = "a literal belongs on the right"


class UnsupportedValue(ParseError):
    says = "no literal of this kind"


class InvalidNumber(ParseError):
    says = "not a number that fits"


class PlanError(ShardloomError):
    """A query that parses but doesn't fit the table."""

    status = 400


class UnknownColumn(PlanError):
    pass


class TypeMismatch(PlanError):
    pass


class NotGrouped(PlanError):
    pass


class StorageError(ShardloomError):
    pass


class TableNotFound(StorageError):
    status = 404


class TableExists(StorageError):
    status = 400


class SnapshotNotFound(StorageError):
    status = 404


class AlertError(ShardloomError):
    status = 400


class AlertNotFound(AlertError):
    status = 404


class CheckError(AlertError):
    """A condition that can't be evaluated on a result."""
