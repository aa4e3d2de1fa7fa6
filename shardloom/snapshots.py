"""Snapshots: every table's rows as Parquet with its configuration, and back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from .engine import Engine
from .errors import SnapshotNotFound
from .sources.catalog import TableConfig
from .sources.files import Store
from .types import Tag

_LATEST = "_latest"


@dataclass(frozen=True)
class SnapshotMeta:
    id: str
    created_ms: int
    tables: tuple[str, ...]
    rows: int


def snapshot(engine: Engine, folder: str) -> SnapshotMeta:
    """Write all tables; the pointer to the newest snapshot moves last."""
    store = Store(engine.spark, folder)
    now = engine.now_ms()
    name = f"snapshot_{now:015d}"
    while store.exists(name):
        now += 1
        name = f"snapshot_{now:015d}"
    rows, tables = 0, {}
    for t in engine.catalog.names():
        table = engine.catalog.get(t)
        table.scan().write.parquet(store.path(name, t))
        rows += engine.spark.read.parquet(store.path(name, t)).count()
        tables[t] = {"config": asdict(table.config), "tags": {n: tag.value for n, tag in table.tags.items()}}
    meta = SnapshotMeta(name, now, tuple(tables), rows)
    store.write_text(f"{name}/_meta.json", json.dumps({"id": name, "created_ms": now, "rows": rows, "tables": tables}))
    store.write_text(_LATEST, name)
    return meta


def _meta(store: Store, name: str) -> dict:
    if not store.exists(f"{name}/_meta.json"):
        raise SnapshotNotFound(name)
    return json.loads(store.read_text(f"{name}/_meta.json"))


def restore(engine: Engine, folder: str, name: str | None = None) -> SnapshotMeta:
    """Replace the engine's tables of the same names by a snapshot's; the newest by default."""
    store = Store(engine.spark, folder)
    if name is None:
        if not store.exists(_LATEST):
            raise SnapshotNotFound("latest")
        name = store.read_text(_LATEST).strip()
    meta = _meta(store, name)
    for t, state in meta["tables"].items():
        if t in engine.catalog.tables:
            engine.drop_table(t)
        table = engine.create_table(TableConfig(**state["config"]))
        tags = {n: Tag(x) for n, x in state["tags"].items()}
        if tags:
            table.append(engine.spark.read.schema(_schema(tags)).parquet(store.path(name, t)), tags)
        engine.cache.invalidate(t)
    return SnapshotMeta(meta["id"], meta["created_ms"], tuple(meta["tables"]), meta["rows"])


def _schema(tags: dict[str, Tag]):
    from pyspark.sql import types as T

    from .types import spark_type

    return T.StructType([T.StructField(n, spark_type(Tag.STRING if t is Tag.NULL else t)) for n, t in tags.items()])


def list_snapshots(engine: Engine, folder: str) -> list[SnapshotMeta]:
    """Newest first."""
    store = Store(engine.spark, folder)
    names = [n for n in store.list("") if n.startswith("snapshot_") and store.exists(f"{n}/_meta.json")]
    metas = [_meta(store, n) for n in sorted(names, reverse=True)]
    return [SnapshotMeta(m["id"], m["created_ms"], tuple(m["tables"]), m["rows"]) for m in metas]


def cleanup(engine: Engine, folder: str, keep: int) -> int:
    """Delete all but the newest ``keep``; the number deleted."""
    store = Store(engine.spark, folder)
    gone = list_snapshots(engine, folder)[max(0, keep) :]
    for m in gone:
        store.delete(m.id)
    return len(gone)
