"""Paged REST collections as a batch data source, read-only by construction: it sends GET and nothing else.

Options: ``url``, ``style`` (``offset``: page=1,2,... and ``has_more``; ``cursor``: ``@odata.nextLink``), ``limit`` (100),
``fields``, ``token_env`` (the environment variable of the workers that holds a bearer token; tokens are no option, so that
plans and logs do not hold them). Rows are JSON texts; parse them with a schema of your own. Status 429 and 5xx are
tried again, five times at most, with doubling waits.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 0.5, 30.0


def get_json(url: str, token: str | None, wait=time.sleep) -> dict:
    for attempt in range(ATTEMPTS):
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500 or attempt == ATTEMPTS - 1:
                raise
            after = error.headers.get("Retry-After", "") if error.headers else ""
            wait(min(LONGEST_WAIT, float(after) if after.isdigit() else FIRST_WAIT * 2**attempt))
    raise AssertionError


def offset_pages(fetch, limit: int = 100, **parameters) -> Iterator[dict]:
    page, more = 1, True
    while more:
        answer = fetch(parameters | {"page": page, "limit": limit})
        yield from answer.get("items", ())
        page, more = page + 1, bool(answer.get("has_more"))


def cursor_pages(fetch_url, url: str, **parameters) -> Iterator[dict]:
    """Parameters belong to the first call only; the links have their own."""
    query = urllib.parse.urlencode(parameters)
    link = f"{url}?{query}" if query else url
    while link:
        answer = fetch_url(link)
        yield from answer.get("value", ())
        link = answer.get("@odata.nextLink")


def has_field(url: str, collection: str, field: str, token: str | None) -> bool:
    """Whether a target knows a field: it refuses requests for fields that it does not have."""
    query = urllib.parse.urlencode({"fields": f"id,{field}", "limit": 1})
    try:
        get_json(f"{url}/{collection}?{query}", token)
    except urllib.error.HTTPError as error:
        if error.code in (400, 404, 500):
            return False
        raise
    return True


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple[str]]:
        o = self.options
        token = os.environ.get(o["token_env"]) if "token_env" in o else None
        parameters = {"fields": o["fields"]} if "fields" in o else {}
        if o.get("style", "offset") == "offset":
            rows = offset_pages(lambda q: get_json(f"{o['url']}?{urllib.parse.urlencode(q)}", token), int(o.get("limit", 100)), **parameters)
        else:
            rows = cursor_pages(lambda u: get_json(u, token), o["url"], **parameters)
        for row in rows:
            yield (json.dumps(row, ensure_ascii=False),)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged_json")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
