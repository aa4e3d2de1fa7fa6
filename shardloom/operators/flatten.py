"""JSON to flat columns: objects give ``a.b``, arrays ``a.0``; empty containers vanish."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import TIME_COLUMN, Tag, infer_tag, merge_all

#: Distinct paths that a discovery returns at most; a table that wide is an error.
MAX_PATHS = 10_000


def flatten_row(row: Mapping[str, object]) -> dict[str, object]:
    """One JSON object as a flat dict; nulls stay."""
    return dict(_leaves("", row))


def _leaves(prefix: str, value: object) -> Iterator[tuple[str, object]]:
    if isinstance(value, Mapping):
        children: Iterator[tuple[object, object]] = iter(value.items())
    elif isinstance(value, (list, tuple)):
        children = iter(enumerate(value))
    else:
        yield prefix, value
        return
    for key, child in children:
        yield from _leaves(f"{prefix}.{key}" if prefix else str(key), child)


def as_text(value: object) -> str | None:
    """A cell of a column that became a string column."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def coerce(value: object, tag: Tag) -> object:
    """A JSON value as a cell of a column of this tag."""
    if value is None or tag is Tag.NULL:
        return None
    if tag is Tag.STRING:
        return as_text(value)
    if tag is Tag.FLOAT64:
        return float(value)
    return value


_KINDS = {"BIGINT": Tag.INT64, "STRING": Tag.STRING, "BOOLEAN": Tag.BOOL, "VOID": Tag.NULL, "DOUBLE": Tag.FLOAT64}


def discover(df: DataFrame, column: str) -> dict[str, tuple[tuple[str | int, ...], Tag]]:
    """Dotted name -> (path, tag) of all leaves in a JSON string column, by distributed passes, one per level."""
    level = df.select(F.try_parse_json(F.col(f"`{column}`")).alias("v"), F.array().cast("array<string>").alias("path"))
    level = level.filter("v is not null")
    found: dict[tuple[str, ...], list[Tag]] = {}
    while True:
        exploded = level.lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(
                F.col("key"), F.col("pos"), F.col("value").alias("child")
            )
        )
        # an array's elements have no key; their step says so
        step = F.coalesce(F.concat(F.lit("k"), F.col("key")), F.concat(F.lit("i"), F.col("pos").cast("string")))
        children = exploded.select(F.col("child").alias("v"), F.concat("path", F.array(step)).alias("path"))
        kind = F.schema_of_variant("v")
        container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        kinds = children.select("path", F.when(container, F.lit("CONTAINER")).otherwise(kind).alias("kind")).distinct()
        rows = kinds.limit(MAX_PATHS + 1).collect()
        if len(rows) > MAX_PATHS:
            raise ValueError(f"more than {MAX_PATHS} paths in {column}")
        for r in rows:
            if r.kind != "CONTAINER":
                tag = _KINDS.get(r.kind, Tag.FLOAT64 if r.kind.startswith("DECIMAL") else Tag.STRING)
                found.setdefault(tuple(r.path), []).append(tag)
        if not any(r.kind == "CONTAINER" for r in rows):
            break
        level = children.filter(container)
    out = {}
    for path, tags in sorted(found.items()):
        steps = tuple(s[1:] if s[0] == "k" else int(s[1:]) for s in path)
        tag = merge_all(tags)
        name = ".".join(map(str, steps))
        out[name] = (steps, Tag.TIMESTAMP if name == TIME_COLUMN and tag is Tag.INT64 else tag)
    return out


_CASTS = {Tag.INT64: "bigint", Tag.FLOAT64: "double", Tag.BOOL: "boolean", Tag.STRING: "string", Tag.NULL: "string"}


def json_path(steps: Sequence[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def flatten(df: DataFrame, column: str, paths: Mapping[str, Tag] | None = None, prefix: str = "") -> DataFrame:
    """``df`` without JSON column ``column`` and with a typed column per leaf.

    ``paths``: dotted name -> tag, for known keys (one pass, no discovery); else they are discovered.
    """
    if paths is None:
        known = discover(df, column)
    else:
        known = {n: (tuple(int(p) if p.isdigit() else p for p in n.split(".")), t) for n, t in paths.items()}
    parsed = df.withColumn("__v", F.try_parse_json(F.col(f"`{column}`")))
    out = [F.col(f"`{c}`") for c in df.columns if c != column]
    for name, (steps, tag) in known.items():
        if tag is Tag.TIMESTAMP:
            cell = F.timestamp_millis(F.try_variant_get("__v", json_path(steps), "bigint"))
        elif tag is Tag.STRING:
            # other types are kept as their JSON text
            cell = F.coalesce(F.try_variant_get("__v", json_path(steps), "string"), F.get_json_object(F.col(f"`{column}`"), json_path(steps)))
        else:
            cell = F.try_variant_get("__v", json_path(steps), _CASTS[tag])
        out.append(cell.alias(prefix + name))
    return parsed.select(out)
