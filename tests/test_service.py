"""The router, the server around it, and periodic work."""

import json
import threading
import urllib.request

import pytest

from shardloom import Engine, TableConfig
from shardloom.alerts import AlertChecker
from shardloom.service import Service, serve
from shardloom.upkeep import Upkeep, Worker


@pytest.fixture
def service(spark, tmp_path):
    return Service(Engine(spark, f"file://{tmp_path}/tables", clock=lambda: 1000.0))


def test_ingest_and_query(service):
    body = {"table": "events", "rows": [{"timestamp": 1, "event": "a", "value": 1}, {"timestamp": 2, "event": "b", "value": 2}, {"event": "c"}]}
    assert service.handle("POST", "/ingest", body) == (200, {"inserted": 2, "errors": 1})
    status, answer = service.handle("POST", "/query", {"sql": "SELECT timestamp, value FROM events ORDER BY timestamp"})
    assert status == 200 and answer["rows"] == [[1, 1], [2, 2]] and answer["row_count"] == 2 and answer["availability"] == 100
    assert service.handle("GET", "/tables") == (200, {"tables": ["events"]})
    assert service.handle("GET", "/tables/events/schema")[1]["columns"][0] == {"name": "timestamp", "type": "TIMESTAMP"}
    assert service.handle("GET", "/tables/events")[1]["rows"] == 2 and service.handle("GET", "/stats")[1]["rows"] == 2
    assert service.handle("GET", "/cache/stats")[1]["entries"] == 1
    assert service.handle("POST", "/cache/invalidate") == (200, {"invalidated": 1})
    assert service.handle("DELETE", "/tables/events")[0] == 200


def test_tables_and_errors(service):
    assert service.handle("GET", "/health") == (200, {"status": "ok"})
    assert service.handle("POST", "/tables", {"name": "t", "ttl_ms": 5})[0] == 200
    assert service.engine.catalog.get("t").config == TableConfig("t", ttl_ms=5)
    expected = {
        ("POST", "/tables", "t"): 400, ("POST", "/query", "SELECT"): 400, ("GET", "/tables/nope", None): 404, ("GET", "/nope", None): 404,
        ("DELETE", "/tables/nope", None): 404, ("GET", "/alerts/nope", None): 404,
    }
    for (method, path, text), status in expected.items():
        assert service.handle(method, path, {"name": text, "sql": text})[0] == status
    for body in (None, {"table": "t"}, {"table": 5, "rows": []}, {"table": "t", "rows": [1]}, {"table": "t", "rows": [], "sample_rate": "x"}):
        assert service.handle("POST", "/ingest", body)[0] == 400
    assert service.handle("POST", "/query", {"sql": "SELECT a FROM nope"})[0] == 404


def test_alerts(service):
    service.engine.ingest("t", [{"timestamp": 1, "v": 5}])
    alert = {"id": "a", "query": "SELECT MAX(v) AS m FROM t", "condition": {"kind": "greater_than", "column": "m", "value": 1}}
    assert service.handle("POST", "/alerts", alert)[0] == 200 and service.handle("POST", "/alerts", alert)[0] == 400
    assert service.handle("POST", "/alerts/a/check")[1]["firing"] is True
    assert service.handle("POST", "/alerts/a/disable")[0] == 200 and service.handle("GET", "/alerts/a")[1]["enabled"] is False
    assert service.handle("PUT", "/alerts/a", alert | {"name": "n"})[0] == 200 and service.handle("GET", "/alerts")[1]["alerts"][0]["name"] == "n"
    assert service.handle("DELETE", "/alerts/a")[0] == 200 and service.handle("GET", "/alerts") == (200, {"alerts": []})


def test_traces(service):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000"}
    assert service.handle("POST", "/v1/traces", {"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) == (200, {"partialSuccess": None})
    assert service.handle("POST", "/query", {"sql": "SELECT duration_ms FROM otel_traces"})[1]["rows"] == [[2]]


def test_server(service):
    server = serve(service, port=0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        with urllib.request.urlopen(f"{url}/health", timeout=10) as answer:
            assert json.load(answer) == {"status": "ok"}
        with pytest.raises(urllib.error.HTTPError) as found:
            urllib.request.urlopen(urllib.request.Request(f"{url}/query", b"nonsense"), timeout=10)
        assert found.value.code == 400
    finally:
        server.shutdown()
        server.server_close()


def test_workers(service, tmp_path):
    engine = service.engine
    engine.create_table(TableConfig("t", shard_ms=1000, ttl_ms=10_000, subsample_after_ms=2000, subsample_ratio=0.5))
    engine.ingest("t", [{"timestamp": t} for t in (100, 200, 300, 5100, 9900)])
    upkeep = Upkeep(engine, AlertChecker(engine), f"file://{tmp_path}/snapshots")
    first = upkeep.run_once(10_000)
    assert first["expire"] == 0 and first["alerts"] == [] and first["snapshot"].rows == 5
    assert {s: (x.rows, x.target) for s, x in first["subsample"]["t"].items()} == {0: (3, 2), 5000: (1, 1)}
    assert set(upkeep.run_once(20_000)) == {"alerts"}
    assert upkeep.run_once(70_001)["expire"] == 3
    worker = Worker(100, lambda now: now)
    assert [worker.run_once(t) for t in (0, 50, 100)] == [0, None, 100]
