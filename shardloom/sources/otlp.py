"""OTLP/JSON traces to spans, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int,message:string>,events:array<string>,links:array<string>>"
)
SCHEMA = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,"
    f"scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{_SPAN}>>>>>"
)
# fixed values of the protocol
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUSES = ("UNSET", "OK", "ERROR")
_CELL = "struct<s:string,i:bigint,d:double,b:boolean>"


def _cell(value: Column) -> Column:
    """The one value of an attribute: string, else integer, else double, else boolean."""
    integer = value["intValue"].try_cast("bigint")
    has_s, has_i, has_d = value["stringValue"].isNotNull(), integer.isNotNull(), value["doubleValue"].isNotNull()
    return F.struct(
        value["stringValue"].alias("s"),
        F.when(~has_s, integer).alias("i"),
        F.when(~has_s & ~has_i, value["doubleValue"]).alias("d"),
        F.when(~has_s & ~has_i & ~has_d, value["boolValue"]).alias("b"),
    )


def _map(attributes: Column) -> Column:
    """Attributes by key; arrays and lists, which hold none of the four types, are left out."""
    def some(a):
        v = a["value"]
        return v["stringValue"].isNotNull() | v["intValue"].isNotNull() | v["doubleValue"].isNotNull() | v["boolValue"].isNotNull()

    pairs = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull() & F.coalesce(some(a), F.lit(False)))
    return F.map_from_entries(F.transform(pairs, lambda a: F.struct(a["key"].alias("key"), _cell(a["value"]).alias("value"))))


def _scope(scope: Column) -> Column:
    """The scope's name and version as attributes, where it has them."""
    names = F.array(
        F.struct(F.lit("otel.scope.name").alias("key"), scope["name"].alias("text")),
        F.struct(F.lit("otel.scope.version").alias("key"), scope["version"].alias("text")),
    )
    given = F.filter(names, lambda n: F.coalesce(n["text"] != "", F.lit(False)))
    none = F.lit(None)
    cell = lambda n: F.struct(n["text"].alias("s"), none.cast("bigint").alias("i"), none.cast("double").alias("d"), none.cast("boolean").alias("b"))
    return F.map_from_entries(F.transform(given, lambda n: F.struct(n["key"].alias("key"), cell(n).alias("value"))))


def _named(code: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(code.between(0, len(names) - 1), code)), F.lit(names[0]))


def _ms(nanos: Column) -> Column:
    """Whole milliseconds, in integers: nanoseconds don't fit a double."""
    n, unit = F.coalesce(nanos.try_cast("bigint"), F.lit(0)), F.lit(1_000_000).cast("bigint")
    return F.call_function("div", n - F.pmod(n, unit), unit)


def parse(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans of export requests in a JSON string column, with ``attributes`` as a map of typed cells.

    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN: a span's attributes win over its scope's, these over the resource's.
    """
    text = F.from_json(F.col(f"`{column}`").cast("string"), SCHEMA).alias("r")
    resources = requests.select(text).select(F.explode("r.resourceSpans").alias("rs"))
    scopes = resources.select(F.col("rs.resource.attributes").alias("ra"), F.explode("rs.scopeSpans").alias("ss"))
    spans = scopes.select("ra", F.col("ss.scope").alias("scope"), F.explode("ss.spans").alias("s"))
    start, end = _ms(F.col("s.startTimeUnixNano")), _ms(F.col("s.endTimeUnixNano"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    attributes = F.map_concat(_map(F.col("ra")), _scope(F.col("scope")), _map(F.col("s.attributes")))
    service = F.element_at(_map(F.col("ra")), F.lit("service.name"))["s"]
    return spans.select(
        F.timestamp_millis(start).alias("timestamp"),
        empty("s.traceId").alias("trace_id"),
        empty("s.spanId").alias("span_id"),
        empty("s.parentSpanId").alias("parent_span_id"),
        F.coalesce(service, F.lit("unknown")).alias("service_name"),
        empty("s.name").alias("span_name"),
        _named(F.col("s.kind"), KINDS).alias("span_kind"),
        F.timestamp_millis(start).alias("start_time"),
        F.timestamp_millis(end).alias("end_time"),
        (end - start).alias("duration_ms"),
        _named(F.col("s.status.code"), STATUSES).alias("status_code"),
        empty("s.status.message").alias("status_message"),
        F.coalesce(F.array_size("s.events"), F.lit(0)).cast("bigint").alias("events_count"),
        F.coalesce(F.array_size("s.links"), F.lit(0)).cast("bigint").alias("links_count"),
        attributes.alias("attributes"),
    )


def otlp_to_spans(requests: DataFrame, column: str = "value", keys: list[str] | None = None, max_keys: int = 5000) -> DataFrame:
    """Spans with a column ``attr.<key>`` per attribute, typed by what all its values are.

    ``keys``: the attributes wanted; without them all are found in a pass over the data.
    """
    spans = parse(requests, column)
    entries = spans.select(F.explode("attributes").alias("key", "cell"))
    if keys is not None:
        entries = entries.filter(F.col("key").isin(keys))
    types = entries.groupBy("key").agg(*(F.count(f"cell.{c}").alias(c) for c in "sidb")).limit(max_keys + 1).collect()
    if len(types) > max_keys:
        raise ValueError(f"more than {max_keys} attributes")
    out = [F.col(c) for c in spans.columns if c != "attributes"]
    for r in sorted(types, key=lambda r: r.key):
        cell = F.try_element_at("attributes", F.lit(r.key))
        kinds = {c for c in "sidb" if r[c]}
        if len(kinds) == 1:
            value = cell[next(iter(kinds))]
        elif kinds == {"i", "d"}:
            value = F.coalesce(cell["i"].cast("double"), cell["d"])
        else:
            value = F.coalesce(*(cell[c].cast("string") for c in "sidb"))
        out.append(value.alias(f"attr.{r.key}"))
    return spans.select(out)
