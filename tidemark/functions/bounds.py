"""Parameters read on the driver: date bounds, name lists, settings from the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo


def parse_bound(text: str | None, is_end: bool = False, freq_minutes: int = 1) -> datetime | None:
    """A bound of a range; an end of exactly 10 characters stands for the last slot of its day; NULL if not readable."""
    if not text:
        return None
    for form in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M"):
        try:
            at = datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        return at + timedelta(days=1) - timedelta(minutes=freq_minutes) if is_end and len(text) == 10 else at
    return None


def strict_date(text: str, zone: str = "UTC") -> datetime:
    return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=ZoneInfo(zone))


def name_list(text: str | None) -> list[str]:
    return sorted({p.strip() for p in (text or "").split(",") if p.strip()})


def headers_from(path: str) -> list[str]:
    """``K: v`` lines of a JSON object in a file."""
    with open(path) as f:
        return [f"{k}: {v}" for k, v in json.load(f).items()]


def request_headers(cookie: str | None = None, authorization: str | None = None, extra: dict[str, str] | None = None) -> list[str]:
    own = {"Cookie": cookie, "Authorization": authorization} | (extra or {})
    return [f"{k}: {v}" for k, v in own.items() if v]


@dataclass(frozen=True)
class Settings:
    """Connection settings from environment variables with a prefix."""

    url: str
    zone: str = "UTC"
    cookie: str | None = None
    authorization: str | None = None

    @classmethod
    def from_env(cls, prefix: str = "TIDEMARK_", url: str | None = None, zone: str | None = None) -> Settings:
        """What is given comes first."""
        if not (url := url or os.environ.get(prefix + "URL", "").strip()):
            raise ValueError(f"{prefix}URL is required")
        zone = zone or os.environ.get(prefix + "TIMEZONE", "UTC")
        try:
            ZoneInfo(zone)
        except Exception as e:
            raise ValueError(f"unknown time zone {zone!r}") from e
        return cls(url, zone, os.environ.get(prefix + "COOKIE"), os.environ.get(prefix + "AUTHORIZATION"))
