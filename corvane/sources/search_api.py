"""A search service as a Spark data source, one partition per query.

The fetcher is replaceable, so that tests need no network. Options: ``url``,
``index``, ``token``, ``queries`` (a JSON list of ``{"query", "filters",
"limit"}``), ``on_error`` (``skip`` takes an error for no hits, ``fail`` raises),
``retry`` (further attempts after no answer, 429 or a server's error, each after
twice the wait of the one before) and ``pause`` (most seconds to wait before a
request). No answer at all, or one that is not JSON, has status 0.

As a stream the source goes through the queries in order, ``per_batch`` at a
time; its offset is the next query's number, so a stream that is started again
from its checkpoint goes on where the last committed batch ended.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "query string, rank int, id string, text string, filename string, status int"


def fetch(options: dict, request: dict) -> tuple[int, list[dict]]:
    """POST one search; ``(status, hits)``."""
    body = json.dumps({"q": request["query"], "filter": request.get("filters", []), "limit": request.get("limit", 20)}).encode()
    head = {"Content-Type": "application/json", "Authorization": f"Bearer {options.get('token', '')}"}
    call = urllib.request.Request(f"{options['url']}/indexes/{options['index']}/search", body, head)
    try:
        with urllib.request.urlopen(call, timeout=15) as got:
            return got.status, json.load(got).get("hits", [])
    except urllib.error.HTTPError as e:
        return e.code, []
    except (OSError, ValueError, AttributeError):  # no connection, time out, cut off; not JSON; not an object
        return 0, []


class _Query(InputPartition):
    def __init__(self, request: dict):
        super().__init__(request)
        self.request = request


class SearchReader(DataSourceReader):
    def __init__(self, options: dict, fetcher=fetch):
        self.options, self.fetcher = dict(options), fetcher

    def partitions(self):
        return [_Query(q) for q in json.loads(self.options["queries"])]

    def read(self, partition):
        pause = float(self.options.get("pause", 1.0))
        for attempt in range(1 + int(self.options.get("retry", 0))):
            time.sleep(random.uniform(pause / 2, pause) * 2**attempt)
            status, hits = self.fetcher(self.options, partition.request)
            if status and status != 429 and status < 500:
                break
        if (status >= 400 or not status) and self.options.get("on_error", "skip") == "fail":
            raise RuntimeError(f"search for {partition.request['query']!r} answered {status}")
        for rank, h in enumerate(hits):
            yield partition.request["query"], rank, str(h.get("id")), h.get("text"), h.get("filename"), status


class SearchStream(SearchReader, DataSourceStreamReader):
    def __init__(self, options: dict, fetcher=fetch):
        SearchReader.__init__(self, options, fetcher)
        self.requests = json.loads(self.options["queries"])
        self.reached = 0

    def initialOffset(self):
        return {"next": 0}

    def latestOffset(self):
        self.reached = min(len(self.requests), self.reached + int(self.options.get("per_batch", 8)))
        return {"next": self.reached}

    def partitions(self, start, end):
        self.reached = max(self.reached, end["next"])
        return [_Query(q) for q in self.requests[start["next"] : end["next"]]]

    def commit(self, end):
        self.reached = max(self.reached, end["next"])


class SearchSource(DataSource):
    """``spark.dataSource.register(SearchSource)``, then ``spark.read.format("search_api")``."""

    fetcher = staticmethod(fetch)

    @classmethod
    def name(cls):
        return "search_api"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SearchReader(self.options, type(self).fetcher)

    def streamReader(self, schema):
        return SearchStream(self.options, type(self).fetcher)
