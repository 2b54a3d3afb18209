"""Retries, pushed filters and the stream of the REST source, by the requests that a server sees."""

from __future__ import annotations

import json
import threading
import urllib.error
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import rest


class Service(BaseHTTPRequestHandler):
    """A point each 100 ms; fails as often as ``fail`` says for a path."""

    def do_GET(self):
        at, q, server = urlparse(self.path), parse_qs(urlparse(self.path).query), self.server
        with server.lock:
            server.seen.append(self.path)
            failing = server.fail.get(q.get("page", [at.path])[0], 0)
            if failing:
                server.fail[q.get("page", [at.path])[0]] -= 1
        status, body = 200, ""
        if failing:
            status, body = server.status, "no"
        elif at.path == "/assets":
            page = int(q["page"][0])
            body = json.dumps({"data": [{"id": {"id": f"a{page}"}, "name": "n", "label": "l"}], "hasNext": page < 3})
        else:
            start, end = int(q["startTs"][0]), int(q["endTs"][0])
            times = range(-(-start // 100) * 100, end + 1, 100)
            body = json.dumps({k: [{"ts": t, "value": f"{k}{t}"} for t in times][: int(q["limit"][0])] for k in q["keys"][0].split(",")})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    server.lock, server.seen, server.fail, server.status = threading.Lock(), [], {}, 503
    server.url = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def read(spark, server, **options):
    rest.register(spark)
    return spark.read.format("telemetry_service").options(url=server.url, wait="0.01", **options)


def test_a_page_that_fails_twice_is_read(spark, server):
    server.fail = {"2": 2}
    rows = read(spark, server, kind="assets").option("url", server.url + "/assets").load()
    assert sorted(r["id"] for r in rows.collect()) == ["a0", "a1", "a2", "a3"]
    pages = Counter(parse_qs(urlparse(p).query)["page"][0] for p in server.seen)
    assert pages == {"0": 1, "1": 1, "2": 3, "3": 1}  # pages before are not read again


def test_what_goes_on_failing_or_is_refused(server):
    server.fail = {"/x": 99}
    with pytest.raises(urllib.error.HTTPError):
        rest.get_json(server.url + "/x", {}, retries=2, wait=0.01)
    assert len(server.seen) == 3
    server.status = 404
    with pytest.raises(urllib.error.HTTPError):
        rest.get_json(server.url + "/x", {}, retries=2, wait=0.01)
    assert len(server.seen) == 4  # not tried again


WORK = json.dumps([{"asset_id": a, "year": 2024, "month": m, "start_ms": 10_000 * m, "end_ms": 10_000 * m + 9_999} for a in ("x", "y") for m in (1, 2, 3)])


def asked(server):
    """asset, keys, start, end of the requests."""
    out = []
    for path in server.seen:
        q = parse_qs(urlparse(path).query)
        out.append((urlparse(path).path.split("/")[1], q["keys"][0], int(q["startTs"][0]), int(q["endTs"][0])))
    server.seen.clear()
    return sorted(out)


def test_filters_shape_the_requests(spark, server):
    rows = read(spark, server, keys="a,b", work=WORK).load()
    assert rows.count() == 2 * 3 * 2 * 100 and len(asked(server)) == 6
    some = rows.where("asset_id = 'x' AND month IN (1, 2) AND key = 'b' AND ts >= 15000 AND ts < 25000")
    assert some.count() == 100 and asked(server) == [("x", "b", 15_000, 19_999), ("x", "b", 20_000, 24_999)]
    assert rows.where("ts = 12300").select("value").distinct().count() == 2 and asked(server) == [(a, "a,b", 12_300, 12_300) for a in "xy"]
    # what a request cannot tell is left to Spark
    odd = rows.where((F.col("value") == "a10000") & (F.col("month") == 1) & (F.col("asset_id") != "y"))
    assert [r["ts"] for r in odd.collect()] == [10_000] and len(asked(server)) == 2
    assert rows.where("key = 'c'").count() == 0 and rows.where("ts > 99999999").count() == 0 and asked(server) == []


def test_stream_reads_each_point_once(spark, server, tmp_path):
    rest.register(spark)

    def run(until, assets):
        rows = spark.readStream.format("telemetry_service").options(kind="follow", url=server.url, assets=json.dumps(assets), keys="a", start_ms="1000", until_ms=str(until), limit="7", wait="0.01").load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return Counter((r["asset_id"], r["ts"]) for r in spark.read.schema(rest.SCHEMAS["follow"]).parquet(str(tmp_path / "out")).collect())

    first = run(2_050, ["x"])
    assert first == {("x", t): 1 for t in range(1000, 2051, 100)}
    server.seen.clear()
    second = run(3_000, ["x", "y"])
    assert second == {(a, t): 1 for a in "xy" for t in range(1000, 3001, 100)}
    assert min(s for a, _, s, _ in asked(server) if a == "x") == 2_051  # what was read is not asked for again
