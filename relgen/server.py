"""The HTTP service: parsing, graph, semantics, generation with progress events, jobs and health."""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relgen.jobs import JobStore, ResultCache, health
from relgen.operators import sinks
from relgen.operators.generate import generate
from relgen.operators.validate import violations
from relgen.plans import graph
from relgen.plans.planner import PlanError, build_plan
from relgen.sources.ddl import ParseError, parse
from relgen.sources.model import Check, Column, Enum, ForeignKey, Model, SchemaError, Table, catalog, preflight
from relgen.sources.templates import TEMPLATES

log = logging.getLogger("relgen")
MAX_BODY, MAX_ROWS, TIMEOUT = 10 << 20, 100_000, 600
#: Violations that a response names at most; their number is given in full.
SHOWN = 20
# fixed values: codes of error responses
CODES = {400: "BAD_REQUEST", 404: "NOT_FOUND", 408: "TIMEOUT", 413: "PAYLOAD_TOO_LARGE", 422: "UNPROCESSABLE", 429: "RATE_LIMITED", 500: "INTERNAL_ERROR"}
HEADERS = {"X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}


class RequestError(ValueError):
    """A request that gets an error response."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


class RateLimiter:
    """So many requests of each visitor in a fixed window."""

    def __init__(self, limit: int = 60, seconds: float = 60, clock: Callable[[], float] = time.time) -> None:
        self.limit, self.seconds, self.clock, self.lock = limit, seconds, clock, threading.Lock()
        self.window, self.seen = 0, Counter()

    def allow(self, visitor: str, now: float | None = None) -> bool:
        window = int((self.clock() if now is None else now) // self.seconds)
        with self.lock:
            if window != self.window:
                self.window, self.seen = window, Counter()
            self.seen[visitor] += 1
            return self.seen[visitor] <= self.limit


def model_of(found: dict) -> Model:
    """The model that ``dataclasses.asdict`` made a dictionary of."""
    try:
        tables = [Table(**t | {"columns": [Column(**c) for c in t["columns"]], "foreign_keys": [ForeignKey(**f) for f in t.get("foreign_keys", [])], "checks": [Check(**c) for c in t.get("checks", [])]}) for t in found["tables"]]
        return Model(tables, [Enum(**e) for e in found.get("enums", [])])
    except (KeyError, TypeError) as e:
        raise RequestError(400, f"invalid model: {e}") from e


def _only(body: dict, *allowed: str) -> dict:
    if not isinstance(body, dict):
        raise RequestError(400, "invalid JSON: an object is expected")
    if unknown := sorted(set(body) - set(allowed)):
        raise RequestError(400, f'invalid JSON: unknown field "{unknown[0]}"')
    return body


class Service:
    """What the routes do, without HTTP: each takes a body and returns a JSON value."""

    def __init__(self, spark: SparkSession, jobs: JobStore | None = None, cache_seconds: float = 60, max_rows: int = MAX_ROWS) -> None:
        self.spark, self.jobs, self.cache, self.max_rows = spark, jobs or JobStore(), ResultCache(cache_seconds), max_rows
        self.started = time.time()

    def health(self) -> dict:
        return health(self.started, self.jobs) | {"threads": threading.active_count()}

    def parse(self, body: dict) -> dict:
        text = _only(body, "sql").get("sql") or ""
        if not text.strip():
            raise RequestError(400, "sql field is required")
        try:
            model = parse(text)
        except (ParseError, SchemaError) as e:
            raise RequestError(400, f"parse error: {e}") from e
        return {"tables": len(model.tables), "enums": len(model.enums), "model": asdict(model), "warnings": [f"{t}: {m}" for t, m in preflight(model)]}

    def _catalog(self, body: dict) -> dict:
        found = _only(body, "model").get("model")
        if not found:
            raise RequestError(400, "model is required")
        return catalog(self.spark, model_of(found))

    def graph(self, body: dict) -> dict:
        cat = self._catalog(body)
        graph.check(graph.nodes(cat), graph.edges(cat))
        sizes = graph.degrees(cat).join(graph.junctions(cat).withColumn("junction", F.lit(True)), "table", "left").join(cat["tables"], "table").orderBy("ord")
        nodes = [{"id": f"table:{r['table']}", "table": r["table"], "columns": r["n_columns"], "is_junction": bool(r["junction"])} for r in sizes.collect()]
        optional = cat["fks"].select("table", F.col("ord").alias("i"), F.explode("columns").alias("column")).join(cat["columns"].select("table", "column", "nullable"), ["table", "column"]).groupBy("table", "i").agg(F.bool_and("nullable").alias("nullable"))
        rows = cat["fks"].join(optional.withColumnRenamed("i", "ord"), ["table", "ord"]).join(cat["tables"].select("table", F.col("ord").alias("at")), "table").orderBy("at", "ord")
        edges = [{"id": f"table:{r['table']}->table:{r['ref_table']}", "source": f"table:{r['table']}", "target": f"table:{r['ref_table']}", "label": r["columns"][0], "nullable": r["nullable"]} for r in rows.collect()]
        return {"nodes": nodes, "edges": edges}

    def semantic(self, body: dict) -> dict:
        cat = self._catalog(body)
        roles = graph.table_roles(cat).groupBy("table").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "role"))).alias("roles"))
        rows = cat["tables"].join(roles, "table", "left").orderBy("ord").collect()
        kinds = graph.relationship_kinds(cat).orderBy("table", "columns").collect()
        return {
            "tables": [{"table": r["table"], "roles": [{"role": x["role"], "confidence": -x["s"] / 100} for x in r["roles"] or []]} for r in rows],
            "relationships": [{"table": r["table"], "ref_table": r["ref_table"], "columns": r["columns"], "kind": r["kind"]} for r in kinds],
        }

    def stream(self, body: dict) -> Iterator[tuple[str, dict]]:
        """The events of a generation: stages, progress for each table, then complete or error."""
        job = key = timer = None
        try:
            _only(body, "input", "rows", "seed", "format", "schema_name")
            text = body.get("input") or ""
            try:
                rows, seed = int(body.get("rows") or 0), int(body.get("seed") or 0)
            except (TypeError, ValueError) as e:
                raise RequestError(400, f"rows and seed must be integers: {e}") from e
            kind, schema = "sql" if body.get("format") == "sql" else "csv", body.get("schema_name") or ""
            if not text.strip():
                raise RequestError(400, "input (SQL) is required")
            rows = rows if rows > 0 else 10
            if rows > self.max_rows:
                raise RequestError(400, f"rows exceeds maximum ({self.max_rows})")
            if len(text.encode()) > MAX_BODY:
                raise RequestError(413, "schema too large")
            key = hashlib.sha256("|".join([text, str(rows), str(seed), kind, schema]).encode()).hexdigest()[:32]
            if found := self.cache.get(key):
                yield "complete", found
                return

            def stage(name: str, status: str = "processing") -> tuple[str, dict]:
                return "stage", {"stage": name, "status": status}

            yield stage("parsing")
            model = parse(text)
            yield stage("parsing", "done")
            yield stage("graphing")
            cat = catalog(self.spark, model)
            graph.check(graph.nodes(cat), graph.edges(cat))
            yield stage("graphing", "done")
            yield stage("semantic")
            roles = graph.table_roles(cat).count()
            yield stage("semantic", "done")
            yield stage("planning")
            plan = build_plan(model, rows)
            yield stage("planning", "done")
            yield stage("generating")
            context = self.spark.sparkContext
            context.setJobGroup(key, "relgen generation", interruptOnCancel=True)
            timer = threading.Timer(TIMEOUT, context.cancelJobGroup, [key])
            timer.daemon = True
            timer.start()
            made: list[dict] = []
            data = generate(self.spark, model, rows, seed, progress=lambda t, i, n: made.append({"table": t, "current": i, "total": n}))
            yield from (("progress", x) for x in made)
            yield stage("generating", "done")
            yield stage("exporting")
            lines = sinks.sql_text(data.tables, model, schema) if kind == "sql" else sinks.csv_text(data.tables)
            output = "".join(lines)
            bad = violations(data.tables, model)
            shown = [f"{r['table']}: {r['message']}" for r in bad.limit(SHOWN).collect()]
            yield stage("exporting", "done")
            errors = [f"{t}: {m}" for t, m in data.errors] + shown
            job = self.jobs.add(status="completed", tables=len(data.tables), rows=rows, seed=seed, format=kind, errors=errors, data=output)
            found = {"job_id": job["id"], "status": "completed", "tables": len(data.tables), "planned": len(plan.order), "roles": roles, "data": output, "format": kind, "errors": errors}
            self.cache.put(key, found)
            yield "complete", found
        except RequestError as e:
            yield "error", {"message": str(e), "status": e.status}
        except ParseError as e:
            yield "error", {"message": f"parse error: {e}", "status": 400}
        except (SchemaError, PlanError, graph.GraphError) as e:
            yield "error", {"message": str(e), "status": 422}
        finally:
            if timer:
                timer.cancel()
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def generate(self, body: dict) -> dict:
        event, data = "error", {}
        for event, data in self.stream(body):  # noqa: B007
            pass
        if event == "error":
            raise RequestError(data["status"], data["message"])
        return data

    def job(self, job_id: str) -> dict:
        found = self.jobs.get(int(job_id)) if job_id.isdigit() else None
        if found is None:
            raise RequestError(404 if job_id.isdigit() else 400, f"no job {job_id}")
        return found

    def delete_job(self, job_id: str) -> dict:
        self.job(job_id)
        self.jobs.delete(int(job_id))
        return {"status": "deleted"}

    def answer(self, method: str, path: str, body: dict | None = None) -> object:
        """The JSON value for a request; raises RequestError."""
        posts = {"/api/parse": self.parse, "/api/graph": self.graph, "/api/semantic": self.semantic, "/api/generate": self.generate}
        gets = {"/api/health": self.health, "/api/jobs": self.jobs.list, "/api/templates": lambda: TEMPLATES}
        if method == "POST" and path in posts:
            return posts[path](body)
        if method == "GET" and path in gets:
            return gets[path]()
        if path.startswith("/api/jobs/") and method in ("GET", "DELETE"):
            return (self.job if method == "GET" else self.delete_job)(path.removeprefix("/api/jobs/"))
        raise RequestError(404, f"no route {method} {path}")


def _handler(service: Service, limiter: RateLimiter) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        timeout = TIMEOUT

        def log_message(self, format: str, *args: object) -> None:
            log.info("%s %s", self.client_address[0], format % args)

        def _start(self, status: int, kind: str, size: int | None = None) -> None:
            self.send_response(status)
            for name, value in (HEADERS | {"Content-Type": kind}).items():
                self.send_header(name, value)
            if size is not None:
                self.send_header("Content-Length", str(size))
            self.end_headers()

        def _send(self, status: int, value: object) -> None:
            data = json.dumps(value).encode()
            self._start(status, "application/json", len(data))
            self.wfile.write(data)

        def _body(self) -> dict:
            size = self.headers.get("Content-Length") or "0"
            if not size.isdigit():
                raise RequestError(400, "invalid Content-Length")
            if int(size) > MAX_BODY:
                raise RequestError(413, "request body too large")
            try:
                return json.loads(self.rfile.read(int(size)))
            except ValueError as e:
                raise RequestError(400, f"invalid JSON: {e}") from e

        def _events(self, query: str) -> None:
            self._start(200, "text/event-stream")
            for event, data in service.stream(dict(parse_qsl(query))):
                self.wfile.write(f"event: {event}\ndata: {json.dumps(data)}\n\n".encode())
                self.wfile.flush()

        def _run(self) -> None:
            url = urlsplit(self.path)
            try:
                if not limiter.allow(self.client_address[0]):
                    raise RequestError(429, "too many requests")
                if self.command == "GET" and url.path == "/api/generate/stream":
                    self._events(url.query)
                else:
                    self._send(200, service.answer(self.command, url.path, self._body() if self.command == "POST" else None))
            except RequestError as e:
                self._send(e.status, {"error": {"code": CODES.get(e.status, f"HTTP_{e.status}"), "message": str(e)}})
            except (BrokenPipeError, ConnectionResetError):
                log.info("the client went away")
            except Exception:
                log.exception("request failed")
                self._send(500, {"error": {"code": CODES[500], "message": "internal error"}})

        def do_OPTIONS(self) -> None:
            self._start(204, "text/plain", 0)

        do_GET = do_POST = do_DELETE = _run

    return Handler


def server(spark: SparkSession, port: int = 8080, job_file: str | None = None, limit: int = 60, host: str = "127.0.0.1", clock: Callable[[], float] = time.time) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; ``serve_forever`` runs it, ``shutdown`` ends it."""
    return ThreadingHTTPServer((host, port), _handler(Service(spark, JobStore(job_file)), RateLimiter(limit, clock=clock)))
