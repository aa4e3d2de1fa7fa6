"""The engine's verbs over HTTP: a router without sockets, and a small server around it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from .alerts import Alert, AlertChecker, AlertState, Condition
from .engine import Engine
from .errors import ShardloomError
from .sources.catalog import TableConfig


class BadRequest(ShardloomError):
    status = 400


class NotFound(ShardloomError):
    status = 404


def _need(body: object, key: str, kind: type):
    if not isinstance(body, dict) or not isinstance(body.get(key), kind):
        raise BadRequest(f"{key!r} is missing or not a {kind.__name__}")
    return body[key]


def _alert_json(alert: Alert, state: AlertState) -> dict:
    return asdict(alert) | {"state": asdict(state)}


@dataclass
class Service:
    engine: Engine
    alerts: AlertChecker | None = None

    def __post_init__(self):
        self.alerts = self.alerts or AlertChecker(self.engine)
        self._lock = Lock()  # the engine's registry is one per driver

    def handle(self, method: str, path: str, body: object = None) -> tuple[int, object]:
        """(status, answer as JSON values) of a request."""
        parts = [p for p in path.split("?")[0].split("/") if p]
        try:
            with self._lock:
                return 200, self._route(method.upper(), parts, body)
        except ShardloomError as e:
            return e.status, {"error": str(e)}
        except Exception as e:
            return 500, {"error": f"{type(e).__name__}: {e}"}

    def _route(self, method: str, parts: list[str], body: object) -> object:
        engine = self.engine
        match method, parts:
            case "GET", ["health"]:
                return {"status": "ok"}
            case "POST", ["ingest"]:
                rows = _need(body, "rows", list)
                if not all(isinstance(r, dict) for r in rows):
                    raise BadRequest("rows must be objects")
                rate = body.get("sample_rate")
                if rate is not None and (isinstance(rate, bool) or not isinstance(rate, (int, float))):
                    raise BadRequest("sample_rate must be a number")
                result = engine.ingest(_need(body, "table", str), rows, rate, body.get("seed"))
                return {"inserted": result.inserted, "errors": result.errors}
            case "POST", ["query"]:
                return engine.query(_need(body, "sql", str)).response()
            case "GET", ["tables"]:
                return {"tables": engine.tables()}
            case "POST", ["tables"]:
                known = {k: body[k] for k in ("shard_ms", "ttl_ms") if k in body} if isinstance(body, dict) else {}
                engine.create_table(TableConfig(_need(body, "name", str), **known))
                return {"created": body["name"]}
            case "GET", ["tables", name]:
                return {"name": name, **asdict(engine.catalog.get(name).stats()), "config": asdict(engine.catalog.get(name).config)}
            case "DELETE", ["tables", name]:
                engine.drop_table(name)
                return {"dropped": name}
            case "GET", ["tables", name, "schema"]:
                return {"columns": [{"name": n, "type": t.value} for n, t in engine.schema(name).items()]}
            case "GET", ["stats"]:
                return engine.stats()
            case "GET", ["cache", "stats"]:
                stats = engine.cache.stats()
                return asdict(stats) | {"hit_rate": stats.hit_rate}
            case "POST", ["cache", "invalidate"]:
                return {"invalidated": engine.cache.invalidate(body.get("table") if isinstance(body, dict) else None)}
            case "POST", ["v1", "traces"]:
                if not isinstance(body, dict):
                    raise BadRequest("an export request must be an object")
                return engine.ingest_otlp(engine.spark.createDataFrame([(json.dumps(body),)], "value string"))
            case _, ["alerts", *rest]:
                return self._alerts(method, rest, body)
        raise NotFound(f"{method} /{'/'.join(parts)}")

    def _alerts(self, method: str, rest: list[str], body: object) -> object:
        match method, rest:
            case "GET", []:
                return {"alerts": [_alert_json(a, s) for a, s in self.alerts.list()]}
            case "POST", []:
                self.alerts.add(self._alert(body))
                return {"created": body["id"]}
            case "GET", [alert]:
                return _alert_json(*self.alerts.get(alert))
            case "PUT", [alert]:
                self.alerts.update(self._alert({**body, "id": alert} if isinstance(body, dict) else body))
                return {"updated": alert}
            case "DELETE", [alert]:
                self.alerts.remove(alert)
                return {"removed": alert}
            case "POST", [alert, ("enable" | "disable") as verb]:
                self.alerts.enable(alert, verb == "enable")
                return {verb + "d": alert}
            case "POST", [alert, "check"]:
                return asdict(self.alerts.check(alert))
        raise NotFound("/alerts/" + "/".join(rest))

    @staticmethod
    def _alert(body: object) -> Alert:
        condition = _need(body, "condition", dict)
        plain = {k: body[k] for k in ("name", "interval_ms", "enabled") if k in body}
        found = Condition(_need(condition, "kind", str), condition.get("column"), condition.get("value"))
        return Alert(_need(body, "id", str), _need(body, "query", str), found, **plain)


def serve(service: Service, host: str = "127.0.0.1", port: int = 9000) -> ThreadingHTTPServer:
    """A server that the caller runs with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, answer = service.handle(self.command, self.path, json.loads(raw) if raw else None)
            except ValueError:
                status, answer = 400, {"error": "the body is not JSON"}
            data = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
