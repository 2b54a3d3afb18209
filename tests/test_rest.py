"""The REST data source against a server in this process."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.operators import payload
from tidemark.sources import rest


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        at, q = urlparse(self.path), parse_qs(urlparse(self.path).query)
        if at.path == "/api/auth/user":
            out = {"customerId": {"id": self.headers["X-Authorization"]}}
        elif at.path == "/assets" or at.path == "/api/customer/me/assets":
            page = int(q["page"][0])
            out = {"data": [{"id": {"id": f"a{page}{i}"}, "name": f"n{i}", "label": None} for i in range(int(q["pageSize"][0]))], "hasNext": page < 2}
        else:
            # a point at the start of each second of the first two and two a millisecond later; asset a10 has none
            start, end = int(q["startTs"][0]), int(q["endTs"][0])
            times = [t for t in range(start, min(end, start + 1999) + 1) for _ in range(2) if t % 1000 == 1] + [t for t in range(start, min(end, start + 1999) + 1) if t % 1000 == 0]
            out = {} if "/a10/" in at.path else {k: [{"ts": t, "value": t % 1000} for t in sorted(times)][: int(q["limit"][0])] for k in q["keys"][0].split(",")}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_and_identity(spark, url):
    spark.dataSource.register(rest.TelemetryService)
    assets = spark.read.format("telemetry_service").options(kind="assets", url=f"{url}/assets", pageSize="2").load()
    assert sorted(r["id"] for r in assets.collect()) == ["a00", "a01", "a10", "a11", "a20", "a21"]
    assert rest.customer_id(url, {"X-Authorization": "me"}) == "me"


def test_series(spark, url):
    spark.dataSource.register(rest.TelemetryService)
    work = [{"asset_id": "x y", "year": 2024, "month": m, "start_ms": 1000 * m, "end_ms": 1000 * m + 999} for m in (1, 2)]
    rows = spark.read.format("telemetry_service").options(url=f"{url}/api", keys="b,a", work=json.dumps(work), limit="3").load()
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 12 and rows.where("truncated").count() == 0
    cut = spark.read.format("telemetry_service").options(url=f"{url}/api", keys="b,a", work=json.dumps(work), limit="2").load()
    assert sorted({r["ts"] for r in cut.where("truncated").collect()}) == [1001, 2001]
    wide = payload.widen(rows, ["a", "b"], ["asset_id", "year", "month"]).orderBy("ts").collect()
    assert [(r["asset_id"], r["month"], r["ts"], r["a"], r["b"]) for r in wide] == [("x y", 1, 1000, "0", "0"), ("x y", 1, 1001, "1", "1"), ("x y", 2, 2000, "0", "0"), ("x y", 2, 2001, "1", "1")]
