"""The strict dialect: one single-table SELECT.

    SELECT item [, item]... FROM table [WHERE predicate] [GROUP BY key, ...]
    [ORDER BY key [ASC|DESC], ...] [LIMIT n]

Items are ``*``, columns, COUNT/SUM/AVG/MIN/MAX, PERCENTILE(c, p), P50/P90/P95/P99 and
TIME_BUCKET('n unit', c). Predicates compare a column with a literal or with NOW() less
an interval, and combine with AND, OR and parentheses. All else is refused by name,
never ignored.
"""

from __future__ import annotations

import re

from .. import errors as E
from ..functions.aggregates import NAMED_PERCENTILES, PLAIN
from ..functions.time import parse_interval
from .spec import Aggregate, Ago, And, Bucket, ColumnRef, Comparison, Expression, Item, Literal, Or, OrderKey, Predicate, QuerySpec, Star

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<comment>--[^\n]*|/\*.*?\*/)
    | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<string>'(?:[^']|'')*')
    | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    | (?P<word>[^\W\d]\w*)
    | (?P<op><>|!=|<=|>=|\|\||::|[-+*/%<>=(),.;\[\]])
    )""",
    re.VERBOSE | re.DOTALL,
)
_CLAUSES = {"from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "join", "on", "as", "window", "qualify", "fetch"}
_JOINS = {"join", "inner", "left", "right", "full", "cross", "natural", "outer"}
_REFUSED_OPERATORS = {"in", "between", "is", "ilike", "similar", "rlike", "regexp", "not", "exists"}


class _Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise E.SyntaxProblem(f"unexpected {text[at:].strip()[:20]!r}")
            at = m.end()
            if m.lastgroup != "comment":
                self.items.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.lower() if kind == "word" else ""

    def op(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text if kind == "op" else ""

    def take(self, text: str) -> bool:
        if self.word() == text or self.op() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise E.SyntaxProblem(f"expected {text.upper()} at {self.peek()[1] or 'the end'!r}")


def parse(text: str) -> QuerySpec:
    """The query that ``text`` says, or a ParseError of the kind that names what is wrong."""
    tokens = _Tokens(text)
    while tokens.items and tokens.items[-1] == ("op", ";"):
        tokens.items.pop()
    if not tokens.items:
        raise E.EmptyQuery
    if ("op", ";") in tokens.items:
        raise E.MultipleStatements
    first = tokens.word()
    if first == "with":
        raise E.UnsupportedQuery("WITH")
    if first in ("values", "table") or tokens.op() == "(":
        raise E.UnsupportedQuery(first or "parentheses")
    if first != "select":
        raise E.UnsupportedStatement(first or tokens.peek()[1])
    return _Parser(tokens).select()


class _Parser:
    def __init__(self, tokens: _Tokens):
        self.t = tokens

    def select(self) -> QuerySpec:
        t = self.t
        t.need("select")
        if t.word() in ("distinct", "all"):
            raise E.UnsupportedQuery(t.word().upper())
        items = [self.item()]
        while t.take(","):
            items.append(self.item())
        if not t.take("from"):
            if t.peek()[0] == "end":
                raise E.MissingTable
            raise E.SyntaxProblem(f"expected FROM at {t.peek()[1]!r}")
        table = self.table()
        where = self.predicate() if t.take("where") else None
        group: list[Expression] = []
        if t.take("group"):
            t.need("by")
            group.append(self.group_key())
            while t.take(","):
                group.append(self.group_key())
        if t.word() == "having":
            raise E.UnsupportedQuery("HAVING")
        order: list[OrderKey] = []
        if t.take("order"):
            t.need("by")
            order.append(self.order_key())
            while t.take(","):
                order.append(self.order_key())
        limit = self.limit() if t.take("limit") else None
        if t.word() in ("union", "intersect", "except", "minus", "offset", "fetch", "for", "window", "qualify"):
            raise E.UnsupportedQuery(t.word().upper())
        if t.peek()[0] != "end":
            raise E.SyntaxProblem(f"unexpected {t.peek()[1]!r}")
        return QuerySpec(table, tuple(items), where, tuple(group), tuple(order), limit)

    def item(self) -> Item:
        t = self.t
        if t.take("*"):
            return Item(Star())
        if t.word() in ("case", "cast", "not", "exists"):
            raise E.UnsupportedExpression(t.word().upper())
        if t.peek()[0] in ("number", "string") or t.op() in ("-", "+", "("):
            raise E.UnsupportedExpression(t.peek()[1])
        found = self.expression()
        if t.op() in ("+", "-", "*", "/", "%", "||", "::", "=", "<", ">", "!=", "<>", "<=", ">="):
            raise E.UnsupportedExpression(t.op())
        if t.word() in ("over", "filter", "within"):
            raise E.UnsupportedFunction(t.word().upper())
        alias = None
        if t.take("as"):
            alias = self.identifier()
        elif t.peek()[0] in ("word", "quoted") and t.word() not in _CLAUSES | _JOINS:
            alias = self.identifier()
        return Item(found, alias)

    def identifier(self) -> str:
        kind, text = self.t.next()
        if kind == "word":
            return text
        if kind == "quoted":
            return text[1:-1].replace(text[0] * 2, text[0])
        raise E.ExpectedColumnName(text)

    def dotted(self) -> str:
        parts = [self.identifier()]
        while self.t.op() == "." or self.t.peek()[0] == "number" and self.t.peek()[1].startswith("."):
            kind, text = self.t.next()
            if kind == "number":  # array positions, as in tags.0
                parts += text[1:].split(".")
            elif self.t.op() == "*":
                raise E.UnsupportedProjection(".".join(parts) + ".*")
            else:
                parts.append(self.identifier())
        return ".".join(parts)

    def expression(self) -> Expression:
        """A column, or a call."""
        if self.t.word() and self.t.op(1) == "(":
            return self.call()
        if self.t.peek()[0] not in ("word", "quoted") or self.t.word() in _CLAUSES:
            raise E.UnsupportedProjection(self.t.peek()[1])
        return ColumnRef(self.dotted())

    def call(self) -> Expression:
        t = self.t
        name = t.word()
        t.next()
        t.need("(")
        if name == "time_bucket":
            return self.time_bucket()
        if name not in PLAIN and name not in NAMED_PERCENTILES and name != "percentile":
            raise E.UnsupportedFunction(name)
        if t.word() == "distinct":
            raise E.UnsupportedFunction(f"{name}(DISTINCT)")
        if t.take("*"):
            if name != "count":
                raise E.UnsupportedFunction(f"{name}(*)")
            t.need(")")
            return Aggregate("count", None)
        if t.op() == ")":
            raise E.UnsupportedFunction(f"{name}()")
        if t.word() and t.op(1) == "(" or t.word() in ("case", "cast") or t.peek()[0] not in ("word", "quoted"):
            raise E.UnsupportedExpression(t.peek()[1])
        column = self.dotted()
        p = NAMED_PERCENTILES.get(name)
        if name == "percentile":
            p = 0.5
            if t.take(","):
                p = self.number()
                if not isinstance(p, (int, float)) or not 0 <= p <= 100:
                    raise E.InvalidNumber(str(p))
                p = p / 100 if p > 1 else float(p)
        if t.op() != ")":
            raise E.UnsupportedExpression(t.peek()[1])
        t.next()
        return Aggregate("percentile" if p is not None else name, column, p)

    def time_bucket(self) -> Bucket:
        t = self.t
        kind, text = t.next()
        if kind != "string" or not t.take(",") or t.peek()[0] not in ("word", "quoted"):
            raise E.InvalidTimeBucket
        width = parse_interval(text[1:-1])
        column = self.dotted()
        if not t.take(")"):
            raise E.InvalidTimeBucket
        return Bucket(width, column)

    def table(self) -> str:
        t = self.t
        if t.op() == "(":
            raise E.UnsupportedTableExpression("subquery")
        if t.peek()[0] not in ("word", "quoted") or t.word() in _CLAUSES:
            raise E.MissingTable
        name = self.dotted()
        if t.op() == "(":
            raise E.UnsupportedTableExpression(name)
        if t.op() == "," or t.word() in _JOINS:
            raise E.JoinsNotSupported
        if t.word() == "as" or t.peek()[0] in ("word", "quoted") and t.word() not in _CLAUSES:
            # an alias may stand before a join; both are refused, the join first
            ahead = 2 if t.word() == "as" else 1
            if t.word(ahead) in _JOINS or t.op(ahead) == ",":
                raise E.JoinsNotSupported
            raise E.UnsupportedTableExpression("table alias")
        return name

    def predicate(self) -> Predicate:
        parts = [self.conjunction()]
        while self.t.take("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> Predicate:
        parts = [self.comparison()]
        while self.t.take("and"):
            parts.append(self.comparison())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def comparison(self) -> Predicate:
        t = self.t
        if t.word() in ("not", "exists"):
            raise E.UnsupportedExpression(t.word().upper())
        if t.op() == "(":
            if t.word(1) == "select":
                raise E.UnsupportedExpression("subquery")
            t.next()
            inner = self.predicate()
            t.need(")")
            return inner
        if t.peek()[0] not in ("word", "quoted") or t.op(1) == "(":
            raise E.ExpectedColumnName(t.peek()[1])
        column = self.dotted()
        negated = t.word() == "not" and t.word(1) == "like"
        if negated:
            t.next()
        if t.take("like"):
            value = self.literal()
            if not isinstance(value, str):
                raise E.UnsupportedValue("LIKE needs a string")
            if t.word() == "escape":
                raise E.UnsupportedOperator("ESCAPE")
            return Comparison(column, "not like" if negated else "like", value)
        if t.word() in _REFUSED_OPERATORS:
            raise E.UnsupportedOperator(t.word().upper())
        op = t.op()
        if op not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise E.UnsupportedOperator(t.peek()[1] or "the end")
        t.next()
        value = self.literal()
        if t.op() in ("+", "-", "*", "/", "%", "||"):
            raise E.UnsupportedExpression(t.op())
        return Comparison(column, "!=" if op == "<>" else op, value)

    def literal(self) -> Literal:
        t = self.t
        kind, text = t.peek()
        if kind == "string":
            t.next()
            return text[1:-1].replace("''", "'")
        if kind == "number" or t.op() in ("-", "+"):
            return self.number()
        word = t.word()
        if word in ("true", "false", "null"):
            t.next()
            return {"true": True, "false": False, "null": None}[word]
        if word == "now" and t.op(1) == "(":
            return self.ago()
        if word in ("date", "timestamp", "interval"):
            raise E.UnsupportedValue(word.upper())
        raise E.ExpectedValue(text)

    def number(self) -> int | float:
        t = self.t
        sign = -1 if t.op() == "-" else 1
        if t.op() in ("-", "+"):
            t.next()
        kind, text = t.next()
        if kind != "number":
            raise E.InvalidNumber(text)
        value = sign * (int(text) if text.isdigit() else float(text))
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            raise E.InvalidNumber(text)
        return value

    def ago(self) -> Ago:
        t = self.t
        t.next()
        t.need("(")
        t.need(")")
        if t.op() != "-":
            raise E.UnsupportedExpression("NOW() without an interval")
        t.next()
        if not t.take("interval"):
            raise E.UnsupportedExpression("NOW() - something other than an INTERVAL")
        kind, text = t.next()
        if kind != "string":
            raise E.InvalidInterval(text)
        return Ago(parse_interval(text[1:-1]))

    def group_key(self) -> Expression:
        if self.t.peek()[0] not in ("word", "quoted"):
            raise E.UnsupportedGroupByExpression(self.t.peek()[1])
        if self.t.op(1) == "(" and self.t.word() != "time_bucket":
            raise E.UnsupportedGroupByExpression(self.t.word())
        found = self.expression()
        if self.t.op() not in ("", ","):
            raise E.UnsupportedGroupByExpression(self.t.op())
        return found

    def order_key(self) -> OrderKey:
        t = self.t
        if t.peek()[0] not in ("word", "quoted"):
            raise E.UnsupportedOrderByExpression(t.peek()[1])
        found = self.expression()
        if t.op() not in ("", ","):
            raise E.UnsupportedOrderByExpression(t.op())
        descending = t.take("desc")
        if not descending:
            t.take("asc")
        if t.word() == "nulls":
            raise E.UnsupportedOrderByExpression("NULLS FIRST/LAST")
        return OrderKey(found, descending)

    def limit(self) -> int:
        kind, text = self.t.next()
        if kind != "number" or not text.isdigit():
            raise E.InvalidLimit(text)
        if self.t.op() == ",":
            raise E.InvalidLimit("two values")
        return int(text)
