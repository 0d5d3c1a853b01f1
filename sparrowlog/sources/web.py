"""JSON over HTTP with retries and backoff: a work list of any length as a table, or a few URLs as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SCHEMA = "url string, status int, attempts int, payload string, error string"
RETRY = {429, 500, 502, 503, 504}
MOST_TEXT = 20_000
RESULT = [("status", IntegerType()), ("attempts", IntegerType()), ("payload", StringType()), ("error", StringType())]


def get(url: str, timeout: float) -> tuple[int, dict[str, str], str]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace")


def fetch_json(url: str, timeout: float = 10.0, retries: int = 3, call: Callable = get, sleep: Callable = time.sleep) -> tuple:
    """(url, status, attempts, payload, error). Tries again after 429, 5xx, a challenged 403 and broken connections, as long as
    Retry-After says or twice as long each time; a body that is no JSON is wrapped and cut."""
    status, body, error, attempt = None, None, None, 0
    for attempt in range(1, retries + 2):
        wait = 0.5 * 2 ** (attempt - 1)
        try:
            status, head, body = call(url, timeout)
            error = None
            if status not in RETRY and not (status == 403 and "challenge" in head.get("cf-mitigated", "")):
                break
            after = head.get("retry-after", "")
            wait = float(after) if after.isdigit() else wait
        except OSError as e:
            status, body, error = None, None, str(e)
        if attempt <= retries:
            sleep(min(wait, 60.0))
    if body is not None:
        try:
            json.loads(body)
        except ValueError:
            body = json.dumps({"nonJsonBody": body[:MOST_TEXT]})
    return url, status, attempt, body, error


def fetch_work(work: DataFrame, groups: int = 2, timeout: float = 10.0, retries: int = 3) -> DataFrame:
    """The columns of ``work`` (url, ...) beside status, attempts, payload and error; 1 to 4 requests at a time, as many as groups."""
    kind = StructType([*work.schema.fields, *(StructField(c, t) for c, t in RESULT)])

    def run(batches):
        for batch in batches:
            for i, url in enumerate(batch.column(batch.schema.get_field_index("url")).to_pylist()):
                _, *found = fetch_json(url, timeout, retries)
                columns = [pa.array([x], t) for x, t in zip(found, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *columns], [*batch.schema.names, *[c for c, _ in RESULT]])

    return work.repartition(min(4, max(1, groups))).mapInArrow(run, kind)


class JsonWebSource(DataSource):
    """``spark.read.format("json_web").option("urls", "a b c").option("groups", 2).load()``"""

    @classmethod
    def name(cls):
        return "json_web"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return JsonWebReader(self.options)


class JsonWebReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.groups = min(4, max(1, int(options.get("groups", 2))))  # as many requests at a time
        self.timeout, self.retries = float(options.get("timeout", 10)), int(options.get("retries", 3))

    def partitions(self):
        return [InputPartition(self.urls[i :: self.groups]) for i in range(min(self.groups, max(1, len(self.urls))))]

    def read(self, partition):
        for url in partition.value:
            yield fetch_json(url, self.timeout, self.retries)
