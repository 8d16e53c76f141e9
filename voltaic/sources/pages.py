"""Paged HTTP sources as Python data sources: pages whose number is known, in parallel, and pages that tell whether there are more, to the end.

spark.dataSource.register(PagedSource); spark.read.format("pages").schema(...).options(url=..., ...).load(), or readStream
for what is added. Options:

url, size (100, rows a page), first (1), timeout (30 seconds); pages: how many there are, each read by a task of its own.
Without pages the reader asks for one page after the other, while the reply says has_more, or has a next (a URL of the
same server, a page number, or a cursor that goes back as the parameter cursor), or, being a plain list or an object
that says neither, is a full page. A page that is missing or can't be read is an error, never a shorter result.
auth: bearer (token), api_key (key, key_name: X-API-Key), basic (user, password), none. A token alone means bearer.
per_minute: requests that a reader makes in any minute at most. retries (3): how often a request is made again after
a reply of 429 or 5xx or a broken connection, after wait (1) seconds and twice as many each time, or as the reply's Retry-After says.
"""

from __future__ import annotations

import base64
import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Fields in which replies hold their rows.
_ROWS = ("data", "results")


def authorization(options: dict[str, str]) -> dict[str, str]:
    """The headers of a way to authenticate."""
    kind = options.get("auth", "bearer" if "token" in options else "none").lower()
    if kind == "none":
        return {}
    if kind == "bearer":
        return {"Authorization": f"Bearer {options['token']}"}
    if kind == "api_key":
        return {options.get("key_name", "X-API-Key"): options["key"]}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{options['user']}:{options['password']}".encode()).decode()}
    raise ValueError(f"auth {kind}: bearer, api_key, basic or none")


class Pace:
    """At most so many requests in any minute."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.clock, self.sleep = per_minute, clock, sleep
        self.made: deque[float] = deque()

    def __call__(self) -> None:
        while self.most > 0:
            now = self.clock()
            while self.made and now - self.made[0] >= 60:
                self.made.popleft()
            if len(self.made) < self.most:
                self.made.append(now)
                return
            self.sleep(60 - (now - self.made[0]))


class Client:
    """Requests under a source's options."""

    def __init__(self, options: dict[str, str]):
        self.options, self.headers = options, {"Accept": "application/json"} | authorization(options)
        self.pace = Pace(int(options.get("per_minute", 0)))

    def reply(self, url: str):
        tries, wait = int(self.options.get("retries", 3)), float(self.options.get("wait", 1))
        while True:
            self.pace()
            try:
                with urlopen(Request(url, headers=self.headers), timeout=float(self.options.get("timeout", 30))) as answer:
                    return json.load(answer)
            except HTTPError as error:
                if tries <= 0 or not (error.code == 429 or error.code >= 500):
                    raise
                asked = error.headers.get("Retry-After", "")
                time.sleep(float(asked) if asked.isdigit() else wait)
            except (URLError, ConnectionError, TimeoutError):
                if tries <= 0:
                    raise
                time.sleep(wait)
            tries, wait = tries - 1, wait * 2

    def page(self, place: str | int) -> tuple[list, str | int | None]:
        """The rows of a page and the place of the next one, None after the last. A place is a page's number, a URL, or cursor=..."""
        size = int(self.options.get("size", 100))
        url = self.options["url"]
        if isinstance(place, str) and not place.startswith("cursor="):
            target = place
        else:
            asked = {"cursor": place[7:], "size": size} if isinstance(place, str) else {"page": place, "size": size}
            target = f"{url}{'&' if '?' in url else '?'}{urlencode(asked)}"
        body = self.reply(target)
        if isinstance(body, list):
            rows, more = body, None
        elif (field := next((f for f in (self.options.get("field"), *_ROWS) if f and f in body), None)) is not None:
            rows, more = body[field] or [], body.get("next")
            if more is None or body.get("has_more") is False:
                more = body.get("has_more", False if "next" in body else None)
        else:
            return [body], None  # one object is one row
        number = place if isinstance(place, int) else None
        if more is None:  # nothing is said: a full page may have a next one
            return rows, number + 1 if number is not None and len(rows) >= size else None
        if more is False:
            return rows, None
        if more is True:
            if number is None:
                raise ValueError(f"{target} has more, but doesn't say where")
            if not rows:
                raise ValueError(f"{target} has more, but no rows")
            return rows, number + 1
        if isinstance(more, int):
            return rows, more
        if "/" in more or "?" in more:
            found = urljoin(target, more)
            if urlsplit(found)[:2] != urlsplit(url)[:2]:
                raise ValueError(f"the next page, {found}, is on another server; it would get this one's credentials")
            return rows, found
        return rows, int(more) if more.isdigit() else f"cursor={more}"

    def rest(self, place: str | int) -> Iterator[tuple[list, str | int | None]]:
        """Pages from a place to the end, each with the place of the next."""
        seen = set()
        while place is not None:
            if place in seen:
                raise ValueError(f"page {place} comes again")
            seen.add(place)
            rows, place = self.page(place)
            yield rows, place


class Page(InputPartition):
    """One page of a known number of them, or all from a place on."""

    def __init__(self, place: str | int, alone: bool):
        self.place, self.alone = place, alone


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options = schema.fieldNames(), dict(options)

    def partitions(self):
        first = int(self.options.get("first", 1))
        if "pages" in self.options:
            return [Page(n, True) for n in range(first, first + int(self.options["pages"]))]
        return [Page(first, False)]

    def read(self, partition):
        client = Client(self.options)
        pages = [client.page(partition.place)] if partition.alone else client.rest(partition.place)
        for rows, _ in pages:
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)


class PagedStreamReader(SimpleDataSourceStreamReader):
    """Rows that the source has beyond those read: an offset is a page's place and how many of its rows were read, so a last
    page that fills up later is read on. Rows are told by their places, so pages must only grow."""

    def __init__(self, schema, options):
        self.columns, self.options = schema.fieldNames(), dict(options)

    def initialOffset(self):
        return {"place": int(self.options.get("first", 1)), "read": 0}

    def _from(self, start: dict) -> tuple[list[tuple], dict]:
        out, at = [], dict(start)
        for rows, following in Client(self.options).rest(start["place"]):
            out += [tuple(row.get(c) for c in self.columns) for row in rows[at["read"] :]]
            at = {"place": at["place"], "read": len(rows)} if following is None else {"place": following, "read": 0}
        return out, at

    def read(self, start):
        rows, end = self._from(start)
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        """The same rows once more, after a failure."""
        out, at = [], dict(start)
        for rows, following in Client(self.options).rest(start["place"]):
            last = at["place"] == end["place"]
            out += [tuple(row.get(c) for c in self.columns) for row in rows[at["read"] : end["read"] if last else None]]
            if last:
                break
            at = {"place": following, "read": 0}
        return iter(out)


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "pages"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def simpleStreamReader(self, schema):
        return PagedStreamReader(schema, self.options)
