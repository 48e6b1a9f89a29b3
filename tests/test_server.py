import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from relgen.server import RateLimiter, RequestError, Service, server
from relgen.sources.ddl import parse
from relgen.sources.templates import TEMPLATES

DDL = "CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, a_id INT REFERENCES a(id));"


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark)


def test_parse_graph_semantic(service):
    found = service.parse({"sql": DDL})
    assert (found["tables"], found["enums"], found["warnings"]) == (2, 0, [])
    model = json.loads(json.dumps(found["model"]))
    drawn = service.graph({"model": model})
    assert [n["table"] for n in drawn["nodes"]] == ["a", "b"]
    assert drawn["edges"] == [{"id": "table:b->table:a", "source": "table:b", "target": "table:a", "label": "a_id", "nullable": True}]
    meant = service.semantic({"model": model})
    assert meant["relationships"][0]["kind"] == "aggregation" and {"role": "entity", "confidence": 0.5} in meant["tables"][0]["roles"]


@pytest.mark.parametrize(("route", "body", "status"), [("/api/parse", {"sql": " "}, 400), ("/api/parse", {"sql": "SELECT 1;"}, 400), ("/api/parse", {"x": 1}, 400), ("/api/parse", [], 400), ("/api/graph", {}, 400), ("/api/graph", {"model": {"tables": [{}]}}, 400), ("/api/generate", {"input": DDL, "rows": 100_001}, 400), ("/api/generate", {"input": DDL, "rows": "x"}, 400), ("/api/generate", {"input": "CREATE TABLE x (id INT PRIMARY KEY, y INT NOT NULL REFERENCES x(id));"}, 422), ("/api/none", {}, 404)])
def test_errors(service, route, body, status):
    with pytest.raises(RequestError) as e:
        service.answer("POST", route, body)
    assert e.value.status == status


def test_events_and_jobs(service):
    events = list(service.stream({"input": DDL, "rows": 3, "format": "sql"}))
    assert [d["stage"] for e, d in events if e == "stage" and d["status"] == "done"] == ["parsing", "graphing", "semantic", "planning", "generating", "exporting"]
    assert [d["table"] for e, d in events if e == "progress"] == ["a", "b"]
    last, done = events[-1]
    assert last == "complete" and done["errors"] == [] and done["data"].count("\n(") + done["data"].count(",\n(") >= 3
    assert list(service.stream({"input": DDL, "rows": 3, "format": "sql"})) == [("complete", done)]
    job = service.answer("GET", f"/api/jobs/{done['job_id']}")
    assert job["data"] == done["data"] and service.answer("GET", "/api/jobs")[0]["id"] == job["id"]
    assert service.answer("DELETE", f"/api/jobs/{job['id']}") == {"status": "deleted"}
    for path, status in ((f"/api/jobs/{job['id']}", 404), ("/api/jobs/x", 400)):
        with pytest.raises(RequestError) as e:
            service.answer("GET", path)
        assert e.value.status == status


def test_http(spark, tmp_path):
    running = server(spark, 0, str(tmp_path / "jobs.json"), limit=5, clock=lambda: 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{running.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{base}/api/health") as r:
            assert json.load(r)["status"] == "ok" and r.headers["X-Frame-Options"] == "DENY"
        request = urllib.request.Request(f"{base}/api/parse", json.dumps({"sql": DDL}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as r:
            assert json.load(r)["tables"] == 2
        with urllib.request.urlopen(f"{base}/api/generate/stream?" + urllib.parse.urlencode({"input": DDL, "rows": 2})) as r:
            text = r.read().decode()
        assert text.startswith("event: stage\n") and "event: complete\n" in text and (tmp_path / "jobs.json").exists()
        for data, status in ((b"{", 400), (None, 404), (None, 429)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(urllib.request.Request(f"{base}/api/{'parse' if data else 'none'}", data))
            assert e.value.code == status and json.load(e.value)["error"]["code"]
    finally:
        running.shutdown()
        running.server_close()


def test_rate_limiter():
    limiter = RateLimiter(2, 60)
    assert [limiter.allow("a", 1), limiter.allow("a", 2), limiter.allow("a", 3), limiter.allow("b", 3), limiter.allow("a", 61)] == [True, True, False, True, True]


def test_templates():
    assert {n: len(parse(t).tables) for n, t in TEMPLATES.items()} == {"ecommerce": 5, "blog": 5, "saas": 4}
