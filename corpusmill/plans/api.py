"""The engine behind an interface: requests in, plain data out, and a command line.

``Api`` answers what the routes of a service answer; ``handle`` maps paths to its
methods, ``call`` the requests of a tool server, and ``serve`` puts both on a port.
"""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import search as sr
from corpusmill.operators import stats as st
from corpusmill.operators.filters import from_params
from corpusmill.operators.latest import latest
from corpusmill.plans import rank as rk
from corpusmill.plans import retrieve as rt
from corpusmill.runtime import own_dir, table

MOST_RESULTS, MOST_OFFSET = 50, 1000


def clamp(value: Any, low: int, high: int, default: int) -> int:
    """An integer parameter within bounds; what isn't one is the default."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


class Api:
    """Questions about the tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str, now: Column | None = None):
        self.spark, self.dir, self.now = spark, directory, now
        self._all = table(spark, directory, "skills")
        # Without bodies, which only the routes that show or search them read.
        self.skills = latest(self._all, "id", "last_seen", [c for c in self._all.columns if c not in ("id", "body")])
        self._serving: rt.Serving | None = None
        r = table(spark, directory, "repos")
        self.repos = latest(r, "full_name", "last_meta_at", [c for c in r.columns if c != "full_name"])

    def serving(self) -> rt.Serving:
        """The search tables, written at the first search."""
        if self._serving is None:
            path = f"{own_dir(self.spark)}/api-{uuid.uuid4().hex}"
            rt.build_serving(self._all, self.repos, "last_seen", path)
            self._serving = rt.open_serving(self.spark, path)
        return self._serving

    def whole(self, wanted: Column) -> DataFrame:
        """Documents with their bodies: ids are chosen first, so only their rows are read whole."""
        ids = self.skills.filter(wanted).select("id")
        rows = self._all.join(ids, "id", "left_semi")
        return latest(rows, "id", "last_seen", [c for c in self._all.columns if c != "id"])

    @staticmethod
    def _plain(df: DataFrame) -> list[dict]:
        return [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]

    def search(self, params: Mapping[str, str]) -> dict:
        """Results, the number of matches and, if asked for, facets."""
        q, f = params.get("q", ""), from_params(params)
        limit = clamp(params.get("limit"), 1, MOST_RESULTS, 20)
        found = rt.search(self._all, self.repos, q, limit=limit, filters=f, now=self.now, snippets=True, at="last_seen", serving=self.serving())
        out: dict[str, Any] = {"query": q, "results": self._plain(found.orderBy("pos"))}
        rows, _ = self.serving().candidates(q, f, self.now)
        out["total"] = sr.count_matches(rows).first()[0]
        if str(params.get("facets", "")) in ("1", "true"):
            out["facets"] = self._plain(sr.facets(rows.withColumn("kind", F.col("source_kind")), ["kind", "license", "language"], 10))
        return out

    def browse(self, params: Mapping[str, str]) -> list[dict]:
        """A page of documents without a query."""
        sort = params.get("sort", "quality")
        return self._plain(rt.browse(self.skills, self.repos, sort=sort if sort in ("quality", "stars", "newest", "name") else "quality",
                                     limit=clamp(params.get("limit"), 1, MOST_RESULTS, 20), offset=clamp(params.get("offset"), 0, MOST_OFFSET, 0),
                                     filters=from_params(params), now=self.now).orderBy("pos"))

    def skill(self, skill_id: int) -> dict | None:
        """One document with its repository, None if unknown."""
        rows = self._plain(self.whole(F.col("id") == skill_id).join(self.repos.select(F.col("full_name").alias("repo"), "stars", "language"), "repo", "left"))
        return rows[0] if rows else None

    def skill_at(self, repo: str, path: str) -> dict | None:
        """One document by its place, None if unknown."""
        rows = self._plain(self.whole((F.col("repo") == repo) & (F.col("path") == path)).limit(1))
        return rows[0] if rows else None

    def author(self, login: str) -> dict | None:
        """An author's row, None if unknown."""
        rows = self._plain(table(self.spark, self.dir, "authors").filter(F.col("login") == login))
        return rows[0] if rows else None

    def categories(self) -> list[dict]:
        """Documents per category, largest first."""
        return self._plain(st.tally(self.skills.filter("category IS NOT NULL"), "category").orderBy(F.col("n").desc(), "category"))

    def category(self, name: str, params: Mapping[str, str]) -> list[dict]:
        """A page of a category's documents."""
        rows = rt.browse(self.skills.filter(F.col("category") == name), self.repos, limit=clamp(params.get("limit"), 1, MOST_RESULTS, 20),
                         offset=clamp(params.get("offset"), 0, MOST_OFFSET, 0), filters=from_params(params), now=self.now)
        return self._plain(rows.orderBy("pos"))

    def raw(self, skill_id: int) -> str | None:
        """A document's body, None if unknown."""
        row = self.whole(F.col("id") == skill_id).select("body").first()
        return row[0] if row else None

    def repo(self, name: str) -> dict | None:
        """A repository with its documents' ids and names, best first; None if unknown."""
        rows = self._plain(self.repos.filter(F.col("full_name") == name))
        if not rows:
            return None
        own = self.skills.filter(F.col("repo") == name).select("id", "name", "path", "score").orderBy(F.col("score").desc_nulls_last(), "id")
        return {**rows[0], "documents": self._plain(own.limit(MOST_RESULTS))}

    def authors(self, params: Mapping[str, str]) -> list[dict]:
        """The authors with most documents."""
        rows = table(self.spark, self.dir, "authors").orderBy(F.col("skills").desc_nulls_last(), "login")
        return self._plain(rows.limit(clamp(params.get("limit"), 1, MOST_RESULTS, 20)))

    def stats(self) -> dict:
        """Sizes of the corpus."""
        one = self.skills.agg(F.count("*").alias("skills"), F.count_if(F.col("valid") == 1).alias("valid"), F.count_distinct("content_hash").alias("contents"))
        return {**one.first().asDict(), "repos": self.repos.count()}

    def explain(self, skill_id: int) -> dict | None:
        """Where a document's score comes from."""
        ranked = rk.recompute(self.skills, self.repos, self.now if self.now is not None else F.current_timestamp(), table(self.spark, self.dir, "authors").select("login", "followers"))
        rows = self._plain(rk.explain(ranked, skill_id))
        return rows[0] if rows else None


def handle(api: Api, path: str, params: Mapping[str, str]) -> tuple[int, Any]:
    """(status, answer) for a route; unknown routes and keys are 404."""
    parts = [p for p in path.split("/") if p]
    if parts == ["health"]:
        return 200, {"ok": True}
    if parts[:1] != ["api"]:
        return 404, {"error": "not found"}
    rest = parts[1:]
    simple = {"search": lambda: api.search(params), "browse": lambda: api.browse(params), "categories": api.categories, "stats": api.stats, "authors": lambda: api.authors(params)}
    if len(rest) == 1 and rest[0] in simple:
        return 200, simple[rest[0]]()
    found: Any = None
    if rest[:1] == ["skill"] and len(rest) >= 2 and rest[1].isdigit():
        known = {(): api.skill, ("raw",): api.raw, ("explain",): api.explain}.get(tuple(rest[2:]))
        found = known(int(rest[1])) if known else None
    elif rest[:1] == ["skill-at"] and len(rest) > 3:
        found = api.skill_at("/".join(rest[1:3]), "/".join(rest[3:]))
    elif rest[:1] == ["repo"] and len(rest) == 3:
        found = api.repo("/".join(rest[1:]))
    elif len(rest) == 2 and rest[0] in ("author", "category"):
        found = api.author(rest[1]) if rest[0] == "author" else api.category(rest[1], params)
    return (200, found) if found is not None else (404, {"error": "not found"})


# What a tool server offers: name, what it is for, parameters, and the method that answers.
TOOLS: dict[str, tuple[str, dict[str, str], Any]] = {
    "search_skills": ("Documents for a task, best first.", {"q": "string", "limit": "integer"}, lambda api, a: api.search({k: str(v) for k, v in a.items()})),
    "get_skill": ("One document, whole.", {"id": "integer"}, lambda api, a: api.skill(int(a["id"]))),
    "browse_category": ("Documents of a category, best first.", {"category": "string", "limit": "integer"}, lambda api, a: api.category(a["category"], {k: str(v) for k, v in a.items()})),
    "list_categories": ("Categories and their sizes.", {}, lambda api, a: api.categories()),
    "get_author": ("An author's profile.", {"login": "string"}, lambda api, a: api.author(a["login"])),
    "corpus_stats": ("Sizes of the corpus.", {}, lambda api, a: api.stats()),
}


def call(api: Api, request: Mapping[str, Any]) -> dict:
    """Answer of a tool server to one JSON-RPC request: ``tools/list`` and ``tools/call``; anything else is an error."""
    answer: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return answer | {"result": {"capabilities": {"tools": {}}, "serverInfo": {"name": "corpusmill"}}}
    if method == "tools/list":
        listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p, _) in TOOLS.items()]
        return answer | {"result": {"tools": listed}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            found = TOOLS[params["name"]][2](api, params.get("arguments") or {})
        except (KeyError, ValueError, TypeError) as e:
            return answer | {"error": {"code": -32602, "message": f"bad arguments: {e}"}}
        return answer | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "isError": found is None}}
    return answer | {"error": {"code": -32601, "message": "unknown method"}}


def serve(api: Api, port: int = 8080) -> ThreadingHTTPServer:
    """A web server over :func:`handle`; the caller runs ``serve_forever``."""

    class Routes(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            status, found = handle(api, unquote(url.path), dict(parse_qsl(url.query)))
            self._say(status, found)

        def do_POST(self) -> None:  # noqa: N802
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                return self._say(400, {"error": "not JSON"})
            self._say(200, call(api, asked)) if urlsplit(self.path).path == "/tools" and isinstance(asked, dict) else self._say(404, {"error": "not found"})

        def _say(self, status: int, found: Any) -> None:
            body = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Routes)


def main(argv: list[str] | None = None) -> None:
    """Command line: search, show, browse, rank, explain, authors, author, repo, categorize, assess, evaluate, stats, query, serve."""
    p = argparse.ArgumentParser(prog="corpusmill", description=main.__doc__)
    p.add_argument("directory")
    p.add_argument("command", choices=["search", "show", "browse", "rank", "explain", "authors", "categorize", "stats", "query", "evaluate", "assess", "serve", "repo", "author"])
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--filter", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--weight", action="append", default=[], metavar="NAME=VALUE")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    api, params = Api(spark, a.directory), dict(x.split("=", 1) for x in a.filter)
    if a.command == "query":
        from corpusmill.plans.queries import queries

        queries()[a.argument](spark, a.directory).show(a.limit, truncate=60)
    elif a.command in ("rank", "authors"):
        from dataclasses import replace

        from corpusmill.functions.scoring import Weights

        w = replace(Weights(), **{k: float(v) for k, v in (x.split("=", 1) for x in a.weight)})
        ranked = rk.recompute(api.skills, api.repos, F.current_timestamp(), table(spark, a.directory, "authors").select("login", "followers"), w)
        name, score = ("skills", "new_score") if a.command == "rank" else ("authors", "author_score")
        ranked[name].orderBy(F.col(score).desc_nulls_last()).limit(a.limit).show(a.limit, truncate=60)
    elif a.command in ("evaluate", "assess"):
        from corpusmill.plans.queries import queries

        queries()["eval_suite" if a.command == "evaluate" else "assess_bodies"](spark, a.directory).show(a.limit, truncate=80)
    elif a.command == "serve":
        serve(api, clamp(a.argument, 1, 65535, 8080)).serve_forever()
    elif a.command == "categorize":
        from corpusmill.operators.classify import catalogue, classify

        catalogue(classify(api.skills, {c: F.col(c) for c in ("name", "description", "path")})).show(50, truncate=80)
    else:
        answer = {"search": lambda: api.search({"q": a.argument, "limit": str(a.limit), **params}), "browse": lambda: api.browse({"limit": str(a.limit), **params}),
                  "show": lambda: api.skill(int(a.argument)), "explain": lambda: api.explain(int(a.argument)), "stats": api.stats, "repo": lambda: api.repo(a.argument), "author": lambda: api.author(a.argument)}[a.command]()
        print(json.dumps(answer, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
