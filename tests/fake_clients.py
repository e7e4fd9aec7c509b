"""Clients that the remote sources use in tests; importable on executors."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

BULK: list = []
ITEMS = [{"id": i, "name": f"n{i}", "tags": ["a"]} for i in range(7)]


def fetch(url, headers, method="GET", body=None):
    parts = urlsplit(url)
    q = {k: v[0] for k, v in parse_qs(parts.query).items()}
    if parts.path.endswith("/token"):
        form = {k: v[0] for k, v in parse_qs(body or "").items()}
        assert method == "POST" and form["grant_type"] == "client_credentials" and "client_secret" not in url
        return json.dumps({"access_token": "secret"})
    if parts.path == "/v1/databases/db/query":
        assert method == "POST" and headers["Notion-Version"] == "2022-06-28" and headers["Authorization"] == "Bearer t"
        asked = json.loads(body)
        a = int(asked.get("start_cursor", 0))
        b = a + asked["page_size"]
        return json.dumps({"results": ITEMS[a:b], "next_cursor": str(b) if b < len(ITEMS) else None})
    if parts.path.startswith("/services/data/v59.0/query"):
        assert headers["Authorization"] == "Bearer secret"
        a = int(parts.path.rsplit("-", 1)[1]) if "-" in parts.path else 0
        more = {"nextRecordsUrl": f"/services/data/v59.0/query/01-{a + 3}"} if a + 3 < len(ITEMS) else {}
        return json.dumps({"records": ITEMS[a : a + 3], "totalSize": len(ITEMS), **more})
    if parts.path == "/repos/me/it/issues":
        assert headers["Accept"] == "application/vnd.github+json"
        a = int(q.get("after", 0))
        link = f'<{url.split("?")[0]}?after={a + 3}>; rel="next", <http://x/>; rel="last"' if a + 3 < len(ITEMS) else '<http://x/>; rel="first"'
        return json.dumps(ITEMS[a : a + 3]), {"Link": link}
    if parts.path == "/v1/charges":
        a = int(q.get("starting_after", -1)) + 1
        return json.dumps({"data": ITEMS[a : a + int(q["limit"])], "has_more": a + int(q["limit"]) < len(ITEMS)})
    if parts.path == "/crm/v3/objects/contacts":
        assert q.get("hapikey") == "k" or headers.get("Authorization") == "Bearer t"
        a = int(q.get("after", 0))
        return json.dumps({"results": ITEMS[a : a + 3], "paging": {"next": {"after": str(a + 3)}} if a + 3 < len(ITEMS) else {}})
    if parts.path == "/form":
        assert method == "POST" and body == "kind=a+b"
        return json.dumps({"rows": ITEMS[:2]})
    if parts.path == "/private" and headers.get("Authorization") != "Bearer secret":
        raise ValueError("unauthorized")
    if parts.path == "/pages":
        size, page = int(q["page_size"]), int(q["page"])
        return json.dumps({"items": ITEMS[(page - 1) * size : page * size]})
    if parts.path == "/offset":
        a = int(q["offset"])
        return json.dumps(ITEMS[a : a + int(q["limit"])])
    if parts.path == "/cursor":
        a = int(q.get("after", 0))
        return json.dumps({"rows": {"list": ITEMS[a : a + 3]}, "next": {"at": a + 3 if a + 3 < len(ITEMS) else None}})
    if parts.path == "/last":
        a = int(q.get("starting_after", -1)) + 1
        return json.dumps({"data": ITEMS[a : a + 3]})
    if parts.path == "/sheet":
        return json.dumps({"data": {"valueRange": {"values": [["id", "name"], [1, "a"], [2, "b"]]}}})
    return json.dumps({"results": ITEMS})


def bulk(url, headers, body):
    """Notes a bulk request in the file that the address names; refuses documents without a name."""
    path = urlsplit(url).path.removesuffix("/_bulk")
    lines = [json.loads(x) for x in body.decode().splitlines()]
    with open(path, "a") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    bad = [x for x in lines if x.get("name") == "refused"]
    return json.dumps({"errors": bool(bad), "items": [{"index": {"status": 400, "error": "mapper"}} for _ in bad]})


class FakeRedis:
    DATA = {"u:1": ("hash", {"name": "a", "age": "5"}), "u:2": ("string", "text"), "u:3": ("list", ["x", "y"]), "u:4": ("set", {"q", "p"})}

    def __init__(self, log=None, **options):
        self.log, self.done = log, []

    def pipeline(self):
        return self

    def _note(self, *call):
        self.done.append(call)

    def set(self, key, value, ex=None):
        self._note("set", key, value, ex)

    def rpush(self, key, value):
        self._note("rpush", key, value)

    def hset(self, key, mapping):
        self._note("hset", key, mapping)

    def delete(self, key):
        self._note("delete", key)

    def expire(self, key, seconds):
        self._note("expire", key, seconds)

    def execute(self):
        with open(self.log, "a") as f:
            f.writelines(json.dumps(c) + "\n" for c in self.done)
        self.done = []

    def scan_iter(self, match, count):
        return sorted(k for k in self.DATA if k.startswith(match.rstrip("*")))

    def type(self, key):
        return self.DATA[key][0]

    def hgetall(self, key):
        return self.DATA[key][1]

    get = smembers = hgetall

    def lrange(self, key, a, b):
        return self.DATA[key][1]
