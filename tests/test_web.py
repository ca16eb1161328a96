import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import web


@pytest.fixture(scope="module")
def site():
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[-1]) if "=" in self.path else 1
            if self.path.startswith("/gone"):
                self.send_error(404)
                return
            known = self.headers.get("If-None-Match") == '"v1"' and page == 1
            self.send_response(304 if known else 200)
            self.send_header("ETag", '"v1"')
            if page < 3 and not known:
                where = f"http://127.0.0.1:{self.server.server_address[1]}{self.path.split('?')[0]}?page={page + 1}"
                self.send_header("Link", f'<{where}>; rel="next", <x>; rel="last"')
            body = b"" if known else f"page {page} {self.headers.get('X-Who', '')}".encode()
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            return

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


def test_pages_and_conditional_requests(spark, site):
    rows = spark.createDataFrame([(f"{site}/a", None), (f"{site}/b", '"v1"'), (f"{site}/gone", None), ("http://127.0.0.1:1/x", None), (None, None)], "url string, tag string")
    got = web.fetched(rows, "url", "tag", headers={"X-Who": "me"}, at_once=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["url"].rsplit("/", 1)[-1], []).append((r["page"], r["status"], r["body"]))
    assert sorted(by["a"]) == [(i, 200, f"page {i} me") for i in (1, 2, 3)]
    assert by["b"] == [(1, 304, None)] and by["gone"] == [(1, 404, None)] and by["x"] == [(1, 0, None)]
    assert len(list(web.pages(f"{site}/a", most=2))) == 2
    assert web.fetched(rows.limit(0), "url").count() == 0


def test_paged_data_source(spark, site):
    web.register(spark)
    df = spark.read.format("paged").option("urls", f"{site}/a {site}/c").option("header.X-Who", "you").load()
    assert sorted((r["url"][-1], r["page"], r["body"]) for r in df.collect()) == [(x, i, f"page {i} you") for x in "ac" for i in (1, 2, 3)]


def test_batches_shards_and_sweeps(spark):
    names = spark.createDataFrame([(f"o/r{i:02d}",) for i in range(7)] + [("bad",), ('o/"x',), (None,)], "full_name string")
    got = {r["batch"]: r for r in web.graphql_batches(names, "stargazerCount", size=3).collect()}
    assert [got[i]["n"] for i in range(3)] == [3, 3, 1]
    assert got[0]["query"].startswith('query { r0: repository(owner: "o", name: "r00") { stargazerCount } r1:')
    sizes = [1] * 5 + [50] * 30 + [99]
    count = lambda a, b: sum(a <= x <= b for x in sizes)
    shards = web.size_shards(0, 100, count, 10)
    assert sum(count(a, b) for a, b in shards) == len(sizes) and all(count(a, b) <= 10 or a == b for a, b in shards)
    assert web.sweep_queries(["t"], ["w"], [(0, 9), (10, None)]) == ["topic:t stars:0..9", "topic:t stars:>=10", '"w" in:name,description,readme stars:0..9', '"w" in:name,description,readme stars:>=10']
    url = spark.range(1).select(web.raw_url(F.lit("o/r"), F.lit(None).cast("string"), F.lit("a/b.md"))).first()[0]
    assert url == "https://raw.githubusercontent.com/o/r/HEAD/a/b.md"
