"""The strict dialect: what it accepts, and how it refuses the rest."""

import pytest

from shardloom import errors as E
from shardloom.functions.time import parse_interval
from shardloom.plans.parser import parse
from shardloom.plans.spec import Aggregate, Ago, And, Bucket, ColumnRef, Comparison, Or, Star

REFUSED = {
    "": E.EmptyQuery,
    " ; ": E.EmptyQuery,
    "SELECT a FROM b; SELECT a FROM c": E.MultipleStatements,
    "INSERT INTO a VALUES (1)": E.UnsupportedStatement,
    "DROP TABLE a": E.UnsupportedStatement,
    "WITH x AS (SELECT 1) SELECT a FROM x": E.UnsupportedQuery,
    "VALUES (1)": E.UnsupportedQuery,
    "SELECT a FROM b UNION SELECT a FROM c": E.UnsupportedQuery,
    "SELECT a FROM b INTERSECT SELECT a FROM c": E.UnsupportedQuery,
    "SELECT DISTINCT a FROM b": E.UnsupportedQuery,
    "SELECT a FROM b GROUP BY a HAVING a > 1": E.UnsupportedQuery,
    "SELECT a FROM b LIMIT 1 OFFSET 1": E.UnsupportedQuery,
    "SELECT a": E.MissingTable,
    "SELECT a FROM": E.MissingTable,
    "SELECT * FROM a JOIN b ON a.id = b.id": E.JoinsNotSupported,
    "SELECT * FROM a x LEFT JOIN b ON x.id = b.id": E.JoinsNotSupported,
    "SELECT * FROM a, b": E.JoinsNotSupported,
    "SELECT * FROM (SELECT a FROM b)": E.UnsupportedTableExpression,
    "SELECT a FROM b AS c": E.UnsupportedTableExpression,
    "SELECT b.* FROM b": E.UnsupportedProjection,
    "SELECT upper(a) FROM b": E.UnsupportedFunction,
    "SELECT COUNT(DISTINCT a) FROM b": E.UnsupportedFunction,
    "SELECT SUM(*) FROM b": E.UnsupportedFunction,
    "SELECT SUM(a) OVER () FROM b": E.UnsupportedFunction,
    "SELECT a + 1 FROM b": E.UnsupportedExpression,
    "SELECT CASE WHEN a THEN 1 END FROM b": E.UnsupportedExpression,
    "SELECT 1 FROM b": E.UnsupportedExpression,
    "SELECT a FROM b WHERE NOT a = 1": E.UnsupportedExpression,
    "SELECT a FROM b WHERE a = NOW()": E.UnsupportedExpression,
    "SELECT a FROM b WHERE a IN (1)": E.UnsupportedOperator,
    "SELECT a FROM b WHERE a BETWEEN 1 AND 2": E.UnsupportedOperator,
    "SELECT a FROM b WHERE a IS NULL": E.UnsupportedOperator,
    "SELECT a FROM b WHERE a ILIKE 'x'": E.UnsupportedOperator,
    "SELECT a FROM b WHERE 1 = a": E.ExpectedColumnName,
    "SELECT a FROM b WHERE a = c": E.ExpectedValue,
    "SELECT a FROM b WHERE a > (SELECT 1)": E.ExpectedValue,
    "SELECT a FROM b WHERE a = -x": E.InvalidNumber,
    "SELECT a FROM b WHERE a LIKE 5": E.UnsupportedValue,
    "SELECT a FROM b WHERE a = DATE '2024-01-01'": E.UnsupportedValue,
    "SELECT TIME_BUCKET('5 parsecs', t) FROM b": E.InvalidInterval,
    "SELECT TIME_BUCKET('0 s', t) FROM b": E.InvalidInterval,
    "SELECT a FROM b WHERE t > NOW() - INTERVAL '1' HOUR": E.InvalidInterval,
    "SELECT TIME_BUCKET(t, 300) FROM b": E.InvalidTimeBucket,
    "SELECT a FROM b GROUP BY 1": E.UnsupportedGroupByExpression,
    "SELECT a FROM b GROUP BY upper(a)": E.UnsupportedGroupByExpression,
    "SELECT a FROM b ORDER BY 1": E.UnsupportedOrderByExpression,
    "SELECT a FROM b ORDER BY a NULLS LAST": E.UnsupportedOrderByExpression,
    "SELECT a FROM b LIMIT x": E.InvalidLimit,
    "SELECT a FROM b LIMIT -1": E.InvalidLimit,
    "SELECT a FROM b WHERE": E.ExpectedColumnName,
    "SELECT a FROM b extra words": E.UnsupportedTableExpression,
    "SELECT a FROM b WHERE a = 'x": E.SyntaxProblem,
}


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(E.ParseError) as found:
        parse(text)
    assert type(found.value) is REFUSED[text]
    assert found.value.status == 400


def test_shape():
    q = parse("""SELECT TIME_BUCKET('5 minutes', timestamp) AS b, "odd name", COUNT(*), P95(a.b) p, PERCENTILE(v, 0.25)
        FROM t -- a comment
        WHERE a.b.0 >= -1.5 AND (x != 'it''s' OR y NOT LIKE '%z_') AND ok = TRUE AND n = NULL AND timestamp > NOW() - INTERVAL '2 hours'
        GROUP BY b, "odd name" ORDER BY p DESC, b LIMIT 7;""")
    assert [i.expression for i in q.items] == [Bucket(300_000, "timestamp"), ColumnRef("odd name"), Aggregate("count", None), Aggregate("percentile", "a.b", 0.95), Aggregate("percentile", "v", 0.25)]
    assert [i.alias for i in q.items] == ["b", None, None, "p", None]
    assert q.where == And((
        Comparison("a.b.0", ">=", -1.5), Or((Comparison("x", "!=", "it's"), Comparison("y", "not like", "%z_"))),
        Comparison("ok", "=", True), Comparison("n", "=", None), Comparison("timestamp", ">", Ago(7_200_000)),
    ))
    assert q.limit == 7 and q.order_by[0].descending and not q.order_by[1].descending
    assert Star() == parse("select * from t").items[0].expression


def test_default_names():
    assert [i.expression.label for i in parse("SELECT COUNT(*), SUM(v), P95(v), PERCENTILE(v, 0.5) FROM t").items] == ["count_*", "sum_v", "percentile(95)_v", "percentile(50)_v"]


@pytest.mark.parametrize(("text", "ms"), [("5 minutes", 300_000), ("1 hour", 3_600_000), ("1 DAY", 86_400_000), ("100 ms", 100), ("2 s", 2000)])
def test_interval(text, ms):
    assert parse_interval(text) == ms


@pytest.mark.parametrize("text", ["", "5", "minutes", "5 5 minutes", "1.5 hours", "-1 hour", "0 s"])
def test_bad_interval(text):
    with pytest.raises(E.InvalidInterval):
        parse_interval(text)
