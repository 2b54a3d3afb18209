"""A paged REST telemetry service as a Spark data source.

Tables by ``kind``: ``assets`` lists assets page by page, ``series`` fetches the
points of assets by month, ``follow`` is a stream of the points that assets have
got since it last looked.  Each asset and month (or stretch of a batch) is a
partition, so a task that is lost is fetched again by itself.  The work-list is
an option (JSON), of a size that a person can ask for.

Filters of a query shape the requests: ``asset_id``, ``year``, ``month`` choose
among the work-list, ``key`` among the keys, ``ts`` narrows the time asked for.

A request that fails is sent again after a wait that doubles each time; a page
or stretch that was read stays read.  A response with as many points as were
asked for may be cut off, so its time is halved and fetched again; rows of a
single millisecond that is still too full have ``truncated`` set.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

POINTS, PAGE = 50_000, 100
#: Times that a request is sent again, seconds before the first of them, and the answers that may be better next time.
RETRIES, WAIT, PASSING = 3, 0.5, (408, 425, 429)
SCHEMAS = {
    "assets": "id string, name string, label string",
    "series": "asset_id string, year int, month int, key string, at int, ts bigint, value string, truncated boolean",
    "follow": "asset_id string, key string, ts bigint, value string, truncated boolean",
}


def get_json(url: str, headers: dict[str, str], timeout: float = 120, retries: int = RETRIES, wait: float = WAIT) -> dict:
    """An answer that is no JSON, a lost connection and an error that may pass are tried again; what is refused is not."""
    while True:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return json.load(r)
        except (OSError, ValueError) as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in PASSING
            if refused or not retries:
                raise
        time.sleep(wait)
        retries, wait = retries - 1, 2 * wait


def customer_id(base: str, headers: dict[str, str]) -> str:
    """The id of the customer that a token belongs to."""
    return get_json(f"{base}/api/auth/user", headers, 30)["customerId"]["id"]


def assets_url(base: str, headers: dict[str, str], kind: str) -> str:
    """Where the assets of a type are listed, for the customer that a token belongs to."""
    return f"{base}/api/customer/{customer_id(base, headers)}/assets?type={urllib.parse.quote(kind)}"


class Request(InputPartition):
    def __init__(self, url: str, **given):
        self.url, self.given = url, given


class Service:
    """What readers share: options (Spark hands names over in lower case), requests, answers that are split."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.base = options["url"].rstrip("/")
        self.headers = json.loads(options.get("headers", "{}"))
        self.limit = int(options.get("limit", POINTS))
        self.again = {"retries": int(options.get("retries", RETRIES)), "wait": float(options.get("wait", WAIT))}

    def series_url(self, asset: str, keys: list[str]) -> str:
        return f"{self.base}/{urllib.parse.quote(asset)}/values/timeseries?keys={urllib.parse.quote(','.join(keys), safe=',')}&agg=NONE&limit={self.limit}"

    def points(self, url: str, start: int, end: int) -> Iterator[tuple[str, dict, bool]]:
        found = get_json(f"{url}&startTs={start}&endTs={end}", self.headers, **self.again)
        full = any(len(points) >= self.limit for points in found.values())
        if full and start < end:
            middle = (start + end) // 2
            yield from self.points(url, start, middle)
            yield from self.points(url, middle + 1, end)
        else:
            yield from ((key, p, full) for key, points in found.items() for p in points)

    def pages(self) -> Iterator[tuple]:
        page, size = 0, int(self.options.get("pagesize", PAGE))
        while True:
            mark = "&" if "?" in self.base else "?"
            found = get_json(f"{self.base}{mark}pageSize={size}&page={page}", self.headers, 60, **self.again)
            for a in found.get("data", []):
                yield a["id"]["id"], a.get("name"), a.get("label")
            if not found.get("hasNext"):
                return
            page += 1


def text(value: object) -> str | None:
    return None if value is None else str(value)


class Reader(DataSourceReader):
    """Options: url, headers (JSON object), kind; ``work`` (JSON list of asset_id, year, month, start_ms, end_ms) and ``keys`` for series; limit, retries, wait."""

    def __init__(self, options: dict[str, str]):
        self.service, self.options = Service(options), options
        self.only: dict[str, set] = {}
        self.since, self.until = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Gives back what requests cannot tell; Spark applies it to the rows."""
        return [f for f in filters if not (self.options.get("kind", "series") == "series" and self._taken(f))]

    def _taken(self, f: Filter) -> bool:
        name = ".".join(getattr(f, "attribute", ()))
        if isinstance(f, (EqualTo, In)) and name in ("asset_id", "key", "year", "month"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only.get(name, values) & values
            return True
        bounds = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}
        if name != "ts" or type(f) not in bounds or not isinstance(f.value, int):
            return False
        low, high = bounds[type(f)]
        self.since = self.since if low is None else max(self.since, f.value + low)
        self.until = self.until if high is None else min(self.until, f.value + high)
        return True

    def _wanted(self, name: str, value: object) -> bool:
        return name not in self.only or value in self.only[name]

    def partitions(self) -> list[Request]:
        if self.options.get("kind", "series") == "assets":
            return [Request("")]
        keys = [k for k in self.options["keys"].split(",") if self._wanted("key", k)]
        out = []
        for w in json.loads(self.options["work"]):
            w |= {"start_ms": max(w["start_ms"], self.since), "end_ms": min(w["end_ms"], self.until)}
            if keys and w["start_ms"] <= w["end_ms"] and all(self._wanted(c, w[c]) for c in ("asset_id", "year", "month")):
                out.append(Request(self.service.series_url(w["asset_id"], keys), **w))
        return out or [Request("", nothing=True)]

    def read(self, part: Request) -> Iterator[tuple]:
        if part.given.get("nothing"):
            return
        if not part.url:
            yield from self.service.pages()
            return
        w = part.given
        for at, (key, p, cut) in enumerate(self.service.points(part.url, w["start_ms"], w["end_ms"])):
            yield w["asset_id"], w["year"], w["month"], key, at, int(p["ts"]), text(p["value"]), cut


class Follower(DataSourceStreamReader):
    """A stream of new points.  Options: url, headers, ``assets`` (JSON list of ids), ``keys``, ``start_ms``; ``until_ms`` (default now) and ``settle_ms``, the age at which points count as all there.

    An offset is the time of each asset from which on points are still to be read, so an asset that is added later
    starts from the beginning, and a stream that goes on from its checkpoint reads every point once.
    """

    def __init__(self, options: dict[str, str]):
        self.service, self.options = Service(options), options
        self.assets = json.loads(options["assets"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = int(self.options.get("until_ms", time.time_ns() // 1_000_000)) - int(self.options.get("settle_ms", 0))
        return {a: now + 1 for a in self.assets}

    def partitions(self, start: dict, end: dict) -> list[Request]:
        keys, first = self.options["keys"].split(","), int(self.options["start_ms"])
        stretches = ((a, int(start.get(a, first)), int(until) - 1) for a, until in end.items())
        return [Request(self.service.series_url(a, keys), asset_id=a, start_ms=lo, end_ms=hi) for a, lo, hi in stretches if lo <= hi] or [Request("", nothing=True)]

    def read(self, part: Request) -> Iterator[tuple]:
        if not part.given.get("nothing"):
            for key, p, cut in self.service.points(part.url, part.given["start_ms"], part.given["end_ms"]):
                yield part.given["asset_id"], key, int(p["ts"]), text(p["value"]), cut


class TelemetryService(DataSource):
    """After ``register(spark)``: ``spark.read.format("telemetry_service")`` or, with kind ``follow``, ``spark.readStream``."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_service"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "series")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> Follower:
        return Follower(dict(self.options))


def register(spark) -> None:
    """Make the source known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TelemetryService)
