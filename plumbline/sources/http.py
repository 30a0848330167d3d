"""A polite HTTP connector: cache first, rate limited, bounded retries. The transport is given, so tests need no network."""

from __future__ import annotations

import hashlib
import json
import os
import random
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: Outcomes that are final; others may be tried again.
TERMINAL = ("OK", "EMPTY", "CLIENT_ERROR")


@dataclass(frozen=True)
class Request:
    endpoint: str
    params: tuple[tuple[str, str], ...] = field(default=())

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.endpoint, sorted(self.params)], separators=(",", ":")).encode()).hexdigest()


@dataclass
class RateLimiter:
    """At least `interval` seconds between calls."""

    interval: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.sleep(self.interval - (now - self.last))
        self.last = self.clock()


class Cache:
    """Responses by request key; files appear whole or not at all, and only final outcomes are kept."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, f"{key}.json")

    def get(self, request: Request) -> dict | None:
        try:
            with open(self._path(request.key), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def put(self, request: Request, result: dict) -> None:
        if result["outcome"] not in TERMINAL:
            return
        fd, tmp = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(result, f, sort_keys=True)
        os.replace(tmp, self._path(request.key))


def classify(status: int | None, body: str | None) -> str:
    if status is None:
        return "NETWORK_ERROR"
    if status == 429:
        return "RATE_LIMITED"
    if status >= 500:
        return "SERVER_ERROR"
    if status >= 400:
        return "CLIENT_ERROR"
    try:
        sets = json.loads(body or "")["resultSets"]
        return "OK" if sets and sets[0]["rowSet"] else "EMPTY"
    except (ValueError, KeyError, TypeError, IndexError):
        return "MALFORMED"


class Client:
    """transport(request) gives (status, body) or raises OSError."""

    def __init__(self, transport, cache: Cache, limiter: RateLimiter, tries: int = 4, base: float = 1.0, cap: float = 30.0, jitter: random.Random | None = None):
        self.transport, self.cache, self.limiter, self.tries, self.base, self.cap = transport, cache, limiter, tries, base, cap
        self.jitter = jitter or random.Random(0)

    def fetch(self, request: Request) -> dict:
        if (known := self.cache.get(request)) is not None:
            return known | {"from_cache": True}
        result: dict = {}
        for n in range(self.tries):
            self.limiter.wait()
            try:
                status, body = self.transport(request)
            except OSError:
                status, body = None, None
            result = {"endpoint": request.endpoint, "status": status, "body": body, "outcome": classify(status, body), "tries": n + 1}
            if result["outcome"] in TERMINAL or result["outcome"] == "MALFORMED":
                break
            if n + 1 < self.tries:
                self.limiter.sleep(min(self.cap, self.base * 2**n) * (0.5 + self.jitter.random() / 2))
        self.cache.put(request, result)
        return result | {"from_cache": False}
