"""Paged REST, Redis and sheet sources as Python data sources.

Their clients are functions that a test or an application may replace: ``rest`` sends a request, ``redis`` needs the
redis package. Readers return rows page by page.
"""

from __future__ import annotations

import base64
import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from riverloom.functions.predicates import ConfigError

#: Where the items of a page are looked for.
ITEM_KEYS = ("data", "items", "results", "records", "list")

#: Addresses, headers and paging of public services; names in braces are options, some with a default.
PRESETS = {
    "salesforce": {
        "url": "{instance_url}/services/data/{api_version}/query?q=SELECT+Id+FROM+{object}",
        "result_key": "records",
        "paging": "next_url",
        "cursor_key": "nextRecordsUrl",
        "auth": "oauth2",
        "token_url": "{login_url}/services/oauth2/token",
    },
    "github": {
        "url": "{base_url}/repos/{repo}/{resource}",
        "paging": "link",
        "size_param": "per_page",
        "auth": "bearer",
        "headers": {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"},
    },
    "hubspot": {
        "url": "{base_url}/crm/v3/objects/{object}",
        "result_key": "results",
        "paging": "cursor",
        "cursor_key": "paging.next.after",
        "cursor_param": "after",
        "size_param": "limit",
        "auth": "api_key",
        "api_key_query": "hapikey",
    },
    "stripe": {
        "url": "{base_url}/v1/{resource}",
        "result_key": "data",
        "paging": "last_id",
        "cursor_param": "starting_after",
        "size_param": "limit",
        "more_key": "has_more",
        "auth": "bearer",
    },
    "notion": {
        "url": "{base_url}/v1/databases/{database_id}/query",
        "method": "POST",
        "body": {},
        "cursor_in": "body",
        "size_param": "page_size",
        "result_key": "results",
        "paging": "cursor",
        "cursor_key": "next_cursor",
        "cursor_param": "start_cursor",
        "auth": "bearer",
        "headers": {"Notion-Version": "{api_version}", "Content-Type": "application/json"},
    },
}
#: Options that a preset's address takes where none are given.
PRESET_DEFAULTS = {
    "salesforce": {"login_url": "https://login.salesforce.com", "api_version": "v59.0", "object": "Account"},
    "github": {"base_url": "https://api.github.com", "resource": "issues"},
    "hubspot": {"base_url": "https://api.hubapi.com", "object": "contacts"},
    "stripe": {"base_url": "https://api.stripe.com", "resource": "charges"},
    "notion": {"base_url": "https://api.notion.com", "api_version": "2022-06-28"},
}
#: Options that hold a service's token, besides ``token``.
TOKEN_NAMES = ("auth_token", "api_key", "secret_key", "integration_token")


def preset_options(name: str, config: dict) -> dict:
    """The options of a service, filled from a configuration, whose own options win."""
    config = dict(config)
    token = next((config[k] for k in ("token", *TOKEN_NAMES) if config.get(k)), None)
    preset = dict(PRESETS[name])
    if name == "hubspot" and not any(config.get(k) for k in ("token", "auth_token")):
        preset["api_key"] = config.get("api_key", "")
    elif name == "hubspot":
        preset["auth"] = "bearer"
        del preset["api_key_query"]
    if token and "token" not in config:
        config["token"] = token
    if name == "salesforce":
        if config.get("token"):
            preset["auth"] = "bearer"
        config.setdefault("instance_url", config.get("login_url", PRESET_DEFAULTS[name]["login_url"]))
    if config.get("resource") in ("prs", "pull_requests") and name == "github":
        config["resource"] = "pulls"
    known = {k: str(v).rstrip("/") for k, v in {**PRESET_DEFAULTS[name], **config}.items() if isinstance(v, (str, int, float))}
    safe = {k: v if k.endswith("_url") else quote(v, safe="/") for k, v in known.items()}

    def fill(value, values):
        try:
            return value.format_map(values) if isinstance(value, str) else value
        except KeyError as e:
            raise ConfigError(f"{name}: {e.args[0]} is required") from e

    own = {k for k in config if config[k] is not None}
    out = {k: fill(v, safe) for k, v in preset.items() if k not in (*own, "headers")}
    out["headers"] = {k: fill(v, known) for k, v in preset.get("headers", {}).items()} | dict(config.get("headers") or {})
    return {**config, **out}


def dig(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def items_of(page, result_key: str | None) -> list:
    if isinstance(page, list):
        return page
    if result_key:
        found = dig(page, result_key)
        return found if isinstance(found, list) else []
    return next((page[k] for k in ITEM_KEYS if isinstance(page.get(k), list)), [])


def mapping(value) -> dict:
    """An option that is a mapping, or its JSON text."""
    if not value:
        return {}
    found = json.loads(value) if isinstance(value, str) else dict(value)
    if not isinstance(found, dict):
        raise ConfigError("rest: a mapping is expected")
    return found


def with_query(url: str, asked: dict) -> str:
    """An address with more query parameters; those that it has of the same names are replaced."""
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in asked]
    return urlunsplit(parts._replace(query=urlencode([*kept, *asked.items()]))) if asked else url


def auth_headers(options: dict[str, str], send: Callable) -> dict[str, str]:
    kind = options.get("auth", options.get("auth_type", "none"))
    if kind == "bearer":
        return {"Authorization": f"Bearer {options.get('token', '')}"}
    if kind in ("basic", "basic_auth"):
        pair = f"{options.get('username', '')}:{options.get('password', '')}".encode()
        return {"Authorization": "Basic " + base64.b64encode(pair).decode()}
    if kind == "api_key":
        if options.get("api_key_query"):
            return {}
        return {options.get("api_key_header", "X-API-Key"): options.get("api_key", options.get("api_key_value", ""))}
    if kind in ("oauth2", "oauth2_client_credentials"):
        form = {"grant_type": "client_credentials", "client_id": options.get("client_id", ""), "client_secret": options.get("client_secret", "")}
        if options.get("scopes"):
            form["scope"] = options["scopes"]
        headers = {"Content-Type": "application/x-www-form-urlencoded"}
        answer = json.loads(send(options["token_url"], headers, "POST", urlencode(form))[0])
        token = answer[options.get("token_field", "access_token")]
        return {"Authorization": options.get("header_format", "Bearer %s") % token}
    if kind in ("none", ""):
        return {}
    raise ConfigError(f"rest: no auth {kind!r}")


def fetch_url(url: str, headers: dict[str, str], method: str = "GET", body: str | None = None) -> tuple[str, dict[str, str]]:
    from urllib.request import Request, urlopen

    data = None if body is None else body.encode()
    with urlopen(Request(url, data, headers, method=method), timeout=30) as answer:
        return answer.read().decode(), dict(answer.headers.items())


def client(path: str | None) -> Callable:
    """A function (url, headers, method, body) by ``module:name``, by default one over HTTP.

    It returns the answer's text, alone or with its headers. One that only takes an address and headers serves GET.
    """
    if not path:
        return fetch_url
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def sender(call: Callable) -> Callable[..., tuple[str, dict[str, str]]]:
    """A client with its answers as (text, headers in lower case)."""

    def send(url, headers, method="GET", body=None):
        answer = call(url, headers) if method == "GET" and body is None else call(url, headers, method, body)
        text, given = answer if isinstance(answer, tuple) else (answer, {})
        return text, {k.lower(): v for k, v in given.items()}

    return send


def next_link(header: str | None) -> str | None:
    """The address of the next page in a Link header."""
    for part in (header or "").split(","):
        if m := re.match(r"""\s*<([^>]+)>.*;\s*rel="?next"?""", part):
            return m.group(1)
    return None


PAGINGS = ("none", "page", "offset", "cursor", "page_token", "last_id", "next_url", "link")


def pages(options: dict[str, str], call: Callable, pause: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """The items of each page until there are no more.

    Pages are asked for by number, offset, cursor, page token or the last item's id, in the address or in the ``body``
    (``cursor_in``), or by the address that an answer names (``next_url``, a Link header). ``{name}`` in the address
    and the body are ``variables``. More than ``max_pages`` pages are an error, so no part is taken for the whole.
    """
    send = sender(call)
    paging = options.get("paging", options.get("pagination", "none")) or "none"
    if paging not in PAGINGS:
        raise ConfigError(f"rest: no paging {paging!r}")
    size, method = int(options.get("page_size", 100)), options.get("method", "GET").upper()
    variables = mapping(options.get("variables"))
    url, text = options["url"], options.get("body")
    for k, v in variables.items():
        url = url.replace("{" + k + "}", quote(str(v), safe=""))
        text = text.replace("{" + k + "}", str(v)) if isinstance(text, str) else text
    headers = {**mapping(options.get("headers")), **auth_headers(options, send)}
    form = options.get("body_type", "json") == "form"
    body = None if method == "GET" and not text else dict(parse_qsl(text)) if form and isinstance(text, str) else mapping(text)
    fixed: dict[str, object] = {}
    if options.get("api_key_query"):
        fixed[options["api_key_query"]] = options.get("api_key", options.get("api_key_value", ""))
    if paging not in ("none", "page", "offset") and options.get("size_param"):
        fixed[options["size_param"]] = size
    in_body = options.get("cursor_in") == "body"
    number, offset, cursor = int(options.get("start_page", 1)), 0, None
    most, count = int(options.get("max_pages", 0)), 0
    while True:
        if most and count >= most:
            raise ConfigError(f"rest: more than {most} pages")
        asked: dict[str, object] = dict(fixed)
        if paging == "page":
            asked |= {options.get("page_param", "page"): number, options.get("size_param", "page_size"): size}
        elif paging == "offset":
            asked |= {options.get("offset_param", "offset"): offset, options.get("limit_param", "limit"): size}
        elif paging in ("cursor", "page_token", "last_id") and cursor is not None:
            asked[options.get("cursor_param", options.get("token_param", "cursor"))] = cursor
        here = cursor if paging in ("next_url", "link") and cursor else url
        full = here if in_body or here is not url else with_query(here, asked)
        content = {**body, **asked} if in_body and body is not None else body
        payload = None if content is None else urlencode(content) if form else json.dumps(content)
        answer, given = _patient(lambda: send(full, headers, method, payload), options, pause)  # noqa: B023
        page = json.loads(answer)
        found = items_of(page, options.get("result_key"))
        count += 1
        if found:
            yield found
        number, offset = number + 1, offset + len(found)
        if paging == "none" or not found and paging != "link" or paging in ("page", "offset") and len(found) < size:
            return
        if options.get("total_field") and isinstance(total := dig(page, options["total_field"]), int) and offset >= total:
            return
        if options.get("more_key") and isinstance(page, dict) and page.get(options["more_key"]) is False:
            return
        if paging in ("cursor", "page_token"):
            cursor = dig(page, options.get("cursor_key", options.get("cursor_field", options.get("token_field", "next_cursor"))))
        elif paging == "last_id":
            cursor = found[-1].get("id")
        elif paging == "next_url":
            cursor = dig(page, options.get("cursor_key", "next"))
            cursor = urljoin(full, cursor) if cursor else None
        elif paging == "link":
            cursor = next_link(given.get("link"))
        if paging not in ("page", "offset") and not cursor:
            return


def _patient(call, options, pause):
    attempts = max(1, int(options.get("max_retries", 3)))
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n + 1 == attempts:
                raise
            pause(min(30.0, float(options.get("retry_base_ms", 1000)) / 1000 * 2.0**n))


def shaped(item, names: list[str]) -> tuple:
    get = item.get if isinstance(item, dict) else {"value": item}.get
    return tuple(v if v is None or isinstance(v, (str, int, float, bool)) else json.dumps(v) for v in map(get, names))


class _Reader(DataSourceReader):
    def __init__(self, rows, schema, options):
        self.rows, self.schema, self.options = rows, schema, dict(options)

    def read(self, partition):
        kinds = [f.dataType for f in self.schema.fields]
        for values in self.rows(self.options, self.schema.names):
            yield tuple(_typed(v, k) for v, k in zip(values, kinds, strict=True))


def _typed(value, kind):
    name = kind.typeName()
    if value is None:
        return None
    if name == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if name in ("long", "integer"):
        return int(value)
    if name == "double":
        return float(value)
    return value


def rest_rows(options: dict[str, str], names: list[str]) -> Iterator[tuple]:
    for page in pages(options, client(options.get("client"))):
        for item in page:
            yield shaped(item, names)


def sheet_rows(options: dict[str, str], names: list[str]) -> Iterator[tuple]:
    """Rows of a sheet's cell range; a first row of texts only is the header."""
    send = sender(client(options.get("client")))
    page = json.loads(send(options["url"], {**mapping(options.get("headers")), **auth_headers(options, send)})[0])
    yield from (shaped(x, names) for x in sheet_records(dig(page, options.get("result_key", "data.valueRange.values")) or []))


def sheet_records(cells: list[list]) -> Iterator[dict]:
    if cells and all(isinstance(c, str) for c in cells[0]):
        head, cells = cells[0], cells[1:]
    else:
        head = [f"col_{i}" for i in range(max(map(len, cells), default=0))]
    for row in cells:
        yield dict(zip(head, row, strict=False))


def redis_rows(options: dict[str, str], names: list[str]) -> Iterator[tuple]:
    """A row per key of a pattern: a hash's fields, a text as ``value``, a list as ``values``, a set as ``members``."""
    module, _, name = (options.get("client") or "redis:Redis").partition(":")
    make = getattr(importlib.import_module(module), name)
    db = make(host=options.get("host", "localhost"), port=int(options.get("port", 6379)), decode_responses=True)
    for key in db.scan_iter(match=options["pattern"], count=1000):
        kind = db.type(key)
        row = {"hash": lambda k: db.hgetall(k), "string": lambda k: {"value": db.get(k)}, "list": lambda k: {"values": db.lrange(k, 0, -1)}, "set": lambda k: {"members": sorted(db.smembers(k))}}.get(kind, lambda k: {})(key)
        yield shaped({"key": key, **row}, names)


def _source(kind: str, rows) -> type[DataSource]:
    class Remote(DataSource):
        @classmethod
        def name(cls):
            return f"riverloom_{kind}"

        def schema(self):
            return "value string"

        def reader(self, schema):
            return _Reader(rows, schema, self.options)

    Remote.__name__ = f"Remote{kind.title()}"
    return Remote


SOURCES = {k: _source(k, f) for k, f in (("rest", rest_rows), ("redis", redis_rows), ("sheet", sheet_rows))}


def register(spark: SparkSession) -> None:
    for s in SOURCES.values():
        spark.dataSource.register(s)
