"""Paged sources against a server of this process: pages to an end that nobody knows, errors, credentials, pace, streams."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from voltaic.sources import pages
from voltaic.streaming import jobs

SCHEMA = "id long, name string, extra string"
KEYS = {"bearer": ("Authorization", "Bearer t"), "key": ("X-Own", "k"), "basic": ("Authorization", "Basic " + base64.b64encode(b"u:p").decode())}


class Server(ThreadingHTTPServer):
    """rows in pages of the size asked for; says how a reply looks, fails holds status codes to give first."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.rows, self.says, self.fails, self.asked = [], "list", [], []
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        s, target = self.server, urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(target.query).items()}
        s.asked.append(self.path)
        wanted = KEYS.get(target.path.strip("/"))
        if s.fails or (wanted and self.headers.get(wanted[0]) != wanted[1]):
            self.send_response(s.fails.pop(0) if s.fails else 401)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        size = int(q.get("size", 3))
        page = int(q["cursor"][1:]) if "cursor" in q else int(q.get("page", 1))
        rows, left = s.rows[(page - 1) * size : page * size], len(s.rows) > page * size
        body = {
            "list": lambda: rows,
            "has_more": lambda: {"data": rows, "has_more": left},
            "next": lambda: {"results": rows, "next": f"/more?page={page + 1}&size={size}" if left else None},
            "number": lambda: {"data": rows, "next": page + 1 if left else None, "has_more": left},
            "cursor": lambda: {"data": rows, "next": f"c{page + 1}" if left else None},
            "field": lambda: {"items": rows, "has_more": left},
            "one": lambda: {"id": 7, "name": "x"},
            "elsewhere": lambda: {"data": rows, "next": "http://127.0.0.2:1/x"},
            "lost": lambda: {"data": [], "has_more": True},
            "circle": lambda: {"data": rows, "next": 1},
        }[s.says]()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture
def server(spark):
    spark.dataSource.register(pages.PagedSource)
    out = Server()
    yield out
    out.shutdown()


def read(spark, server, path="", **options):
    named = {"url": server.url + path, "size": 3, "wait": 0} | options
    return sorted((r.id, r.name, r.extra) for r in spark.read.format("pages").schema(SCHEMA).options(**named).load().collect())


@pytest.mark.parametrize("says", ["list", "has_more", "next", "number", "cursor", "field"])
@pytest.mark.parametrize("n", [0, 1, 3, 9, 10])
def test_every_page_to_the_end(spark, server, says, n):
    server.rows, server.says = [{"id": i, "name": f"n{i}"} for i in range(n)], says
    assert read(spark, server, field="items") == [(i, f"n{i}", None) for i in range(n)]


def test_known_pages_and_single_objects(spark, server):
    server.rows = [{"id": i} for i in range(7)]
    assert len(read(spark, server, "/?of=x", pages=3)) == 7 and all("of=x&page=" in a for a in server.asked)
    server.says = "one"
    assert read(spark, server) == [(7, "x", None)]


def test_failed_requests_are_made_again_or_fail_the_read(spark, server):
    server.rows, server.fails = [{"id": i} for i in range(4)], [503, 429, 500]
    assert len(read(spark, server)) == 4 and len(server.asked) == 5
    server.fails = [503] * 9
    with pytest.raises(Exception, match="503"):
        read(spark, server, retries=2)
    server.fails, server.asked[:] = [404], []
    with pytest.raises(Exception, match="404"):
        read(spark, server)
    assert len(server.asked) == 1


@pytest.mark.parametrize(("says", "message"), [("elsewhere", "another server"), ("lost", "no rows"), ("circle", "comes again")])
def test_what_would_give_less_is_an_error(spark, server, says, message):
    server.rows, server.says = [{"id": i} for i in range(9)], says
    with pytest.raises(Exception, match=message):
        read(spark, server)


def test_credentials(spark, server):
    server.rows = [{"id": 1}]
    assert len(read(spark, server, "/bearer", token="t")) == len(read(spark, server, "/bearer", auth="bearer", token="t")) == 1
    assert len(read(spark, server, "/key", auth="api_key", key="k", key_name="X-Own")) == 1
    assert len(read(spark, server, "/basic", auth="basic", user="u", password="p")) == 1
    assert pages.authorization({"auth": "api_key", "key": "k"}) == {"X-API-Key": "k"} and pages.authorization({}) == {}
    with pytest.raises(Exception, match="401"):
        read(spark, server, "/basic", auth="basic", user="u", password="other")
    with pytest.raises(ValueError, match="auth"):
        pages.authorization({"auth": "ticket"})


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace, made = pages.Pace(3, lambda: now[0], sleep), []
    for _ in range(8):
        pace()
        made.append(now[0])
        now[0] += 1
    assert made == [0, 1, 2, 60, 61, 62, 120, 121] and all(s > 0 for s in slept)


def test_a_stream_reads_what_is_added(spark, server, tmp_path):
    def run():
        source = spark.readStream.format("pages").schema(SCHEMA).options(url=server.url, size=3, wait=0).load()
        return sorted(r.id for r in jobs.drain(source, f"{tmp_path}/out").collect())

    server.says, server.rows = "has_more", [{"id": i} for i in range(4)]
    assert run() == list(range(4))
    server.rows += [{"id": i} for i in range(4, 11)]
    assert run() == list(range(11)) and run() == list(range(11))
    reader = pages.PagedStreamReader(spark.createDataFrame([], SCHEMA).schema, {"url": server.url, "size": "3"})
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 11 and end == {"place": 4, "read": 2}
    server.rows.append({"id": 11})
    assert [r[0] for r in reader.readBetweenOffsets({"place": 2, "read": 1}, end)] == list(range(4, 11))
