"""Downloads as a data source: one partition for each request, endpoints tried in turn, transport by choice."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "wayfare/1.0"


def by_post(endpoint: str, request: str, timeout: float) -> str:
    """A form with the request as `data`."""
    import urllib.parse
    import urllib.request

    form = urllib.parse.urlencode({"data": request}).encode()
    with urllib.request.urlopen(urllib.request.Request(endpoint, form, {"User-Agent": AGENT}), timeout=timeout) as answer:
        return answer.read().decode()


def by_get(endpoint: str, request: str, timeout: float) -> str:
    """The request as `query`, answered in JSON."""
    import urllib.parse
    import urllib.request

    url = f"{endpoint}?{urllib.parse.urlencode({'query': request, 'format': 'json'})}"
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "application/sparql-results+json"}), timeout=timeout) as answer:
        return answer.read().decode()


def file_of(request: str) -> str:
    """The name under which a folder keeps the answer to a request."""
    return hashlib.sha256(request.encode()).hexdigest()[:16] + ".json"


def by_folder(endpoint: str, request: str, timeout: float) -> str:
    """Answers that were kept: the endpoint is a folder, in any store."""
    from wayfare.sources.files import store

    disk, where = store(endpoint)
    with disk.open_input_file(f"{where}/{file_of(request)}") as file:
        return file.read().decode()


TRANSPORTS: dict[str, Callable[[str, str, float], str]] = {"post": by_post, "get": by_get, "folder": by_folder}


@dataclass
class Request(InputPartition):
    number: int
    text: str


class DownloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoints, self.requests = json.loads(options["endpoints"]), json.loads(options["requests"])
        self.transport = options.get("transport", "post")
        self.timeout, self.pause, self.rounds = float(options.get("timeout", 120)), float(options.get("pause", 2)), int(options.get("rounds", 1))
        if self.transport not in TRANSPORTS:
            raise ValueError(f"transport must be one of {sorted(TRANSPORTS)}")

    def partitions(self) -> list[Request]:
        return [Request(i, text) for i, text in enumerate(self.requests)]

    def read(self, partition: Request) -> Iterator[tuple]:
        said, wait = [], self.pause
        for _ in range(self.rounds):
            for endpoint in self.endpoints:
                try:
                    body = TRANSPORTS[self.transport](endpoint, partition.text, self.timeout)
                    json.loads(body)  # an endpoint that answers with an error page is as good as dead
                except Exception as e:  # whatever it is, the next endpoint may do
                    said.append(f"{endpoint}: {e}")
                    time.sleep(wait)
                else:
                    yield partition.number, partition.text, endpoint, body
                    return
            wait *= 2
        raise RuntimeError(f"no endpoint answered request {partition.number}: " + "; ".join(said))


class Download(DataSource):
    """request (its number), query, endpoint that answered, body.

    Options: endpoints and requests (JSON lists), transport (post, get or folder), timeout, pause between endpoints
    (doubled from round to round) and rounds. Fails if no endpoint answers a request.
    """

    @classmethod
    def name(cls) -> str:
        return "wayfare_download"

    def schema(self) -> str:
        return "request int, query string, endpoint string, body string"

    def reader(self, schema) -> DownloadReader:
        return DownloadReader(self.options)


def download(spark: SparkSession, endpoints: list[str], requests: list[str], transport: str = "post", **options: float) -> DataFrame:
    spark.dataSource.register(Download)
    reader = spark.read.format("wayfare_download").option("endpoints", json.dumps(endpoints)).option("requests", json.dumps(requests)).option("transport", transport)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def tiles(south: float, west: float, north: float, east: float, n: int) -> list[tuple[float, float, float, float]]:
    """A box cut into n x n, so that a large area is many requests; what lies on an edge comes twice and is merged by id."""
    at = lambda low, high, i: low + (high - low) * i / n
    return [(at(south, north, i), at(west, east, j), at(south, north, i + 1), at(west, east, j + 1)) for i in range(n) for j in range(n)]
