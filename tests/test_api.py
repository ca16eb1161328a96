import pytest
from pyspark.sql import functions as F

from corpusmill.plans import api as ap
from corpusmill.plans import queries as core


@pytest.fixture(scope="module")
def api(spark, data):
    return ap.Api(spark, data, core.now())


def test_search_route(api):
    status, got = ap.handle(api, "/api/search", {"q": "validate", "limit": "5", "facets": "1"})
    assert status == 200 and 0 < len(got["results"]) <= 5 and got["total"] >= len(got["results"])
    assert [r["pos"] for r in got["results"]] == list(range(1, len(got["results"]) + 1))
    assert any("[" in r["snippet"] or r["snippet"] for r in got["results"]) and {"facet", "value", "n"} <= set(got["facets"][0])


def test_other_routes(api, data):
    assert ap.handle(api, "/health", {}) == (200, {"ok": True})
    some = api.skills.select("id", "repo", "path").first()
    assert ap.handle(api, f"/api/skill/{some['id']}", {})[1]["id"] == some["id"]
    assert api.skill_at(some["repo"], some["path"])["repo"] == some["repo"]
    for path in ("/api/skill/999999999", "/api/skill/x", "/api/author/nobody", "/nothing", "/api"):
        assert ap.handle(api, path, {})[0] == 404
    assert ap.handle(api, "/api/stats", {})[1]["skills"] == api.skills.count()
    assert len(ap.handle(api, "/api/browse", {"limit": "7", "sort": "stars"})[1]) <= 7
    assert ap.handle(api, "/api/categories", {})[0] == 200
    assert api.explain(999999999) is None


def test_parameters():
    assert ap.clamp("900", 1, 50, 20) == 50 and ap.clamp("x", 1, 50, 20) == 20 and ap.clamp(None, 0, 5, 3) == 3
    assert ap.from_params({"min_stars": "x", "kind": "", "include_forks": "true"}) == {"include_forks": True}


def test_no_filter_shows_a_critical_row(api):
    critical = {r["id"] for r in api.skills.filter("risk_level = 'critical'").select("id").collect()}
    from corpusmill.plans.retrieve import browse

    for f in ({}, {"include_forks": True}, {"include_archived": True, "valid_only": False}, {"min_score": 1.0}):
        got = {r["id"] for r in browse(api.skills, api.repos, limit=1000, filters=f, now=F.current_timestamp()).select("id").collect()}
        assert not got & critical


def test_more_routes_tools_and_server(api):
    import json
    import threading
    import urllib.request

    some = api.skills.filter("category IS NOT NULL").select("id", "repo", "path", "category").first()
    assert ap.handle(api, f"/api/skill/{some['id']}/raw", {})[0] == 200
    assert ap.handle(api, f"/api/skill-at/{some['repo']}/{some['path']}", {})[1]["path"] == some["path"]
    assert any(x["id"] == some["id"] for x in ap.handle(api, f"/api/repo/{some['repo']}", {})[1]["documents"])
    assert ap.handle(api, f"/api/category/{some['category']}", {"limit": "3"})[0] == 200
    assert len(ap.handle(api, "/api/authors", {"limit": "4"})[1]) == 4
    assert {t["name"] for t in ap.call(api, {"id": 1, "method": "tools/list"})["result"]["tools"]} == set(ap.TOOLS)
    told = ap.call(api, {"id": 2, "method": "tools/call", "params": {"name": "get_skill", "arguments": {"id": some["id"]}}})
    assert json.loads(told["result"]["content"][0]["text"])["id"] == some["id"]
    assert ap.call(api, {"id": 3, "method": "tools/call", "params": {"name": "get_skill"}})["error"]["code"] == -32602
    assert ap.call(api, {"id": 4, "method": "nothing"})["error"]["code"] == -32601
    server = ap.serve(api, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    where = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.load(urllib.request.urlopen(where + "/api/stats"))["skills"] == api.skills.count()
    ask = urllib.request.Request(where + "/tools", data=b'{"id": 1, "method": "initialize"}')
    assert json.load(urllib.request.urlopen(ask))["result"]["serverInfo"]["name"] == "corpusmill"
    server.shutdown()
    server.server_close()
