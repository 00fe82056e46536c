"""Jobs of a provider as a data source, over a client that the caller injects."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def api_key(variable: str) -> str:
    """From the environment only, so that it never shows in a plan."""
    key = os.environ.get(variable, "").strip()
    if not key:
        raise ValueError(f"the environment variable {variable} is not set")
    return key


def http_client(base: str, variable: str, timeout: float = 30.0) -> Callable[[str], object]:
    """GET of JSON with a bearer token."""

    def get(path: str) -> object:
        with urlopen(Request(f"{base.rstrip('/')}/{path.lstrip('/')}", headers={"Authorization": f"Bearer {api_key(variable)}"}), timeout=timeout) as r:  # noqa: S310
            return json.load(r)

    return get


def rows_of(response: object) -> list[dict]:
    """A list, or an object with data."""
    return list(response.get("data") or []) if isinstance(response, dict) else list(response or [])


class JobSource(DataSource):
    """spark.read.format("quern_jobs") with options path, base and key_variable; one row of raw JSON a job.

    With the option job, only that job's status is asked for; with limit, at most so many jobs are returned.
    """

    client: Callable[[dict], Callable[[str], object]] = staticmethod(lambda o: http_client(o["base"], o["key_variable"]))

    @classmethod
    def name(cls) -> str:
        return "quern_jobs"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).client)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, client) -> None:
        self.options, self.client = options, client

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, one, limit = self.options.get("path", "fine_tuning/jobs"), self.options.get("job"), self.options.get("limit")
        get = self.client(self.options)
        jobs = [get(f"{path}/{one}")] if one else rows_of(get(f"{path}?limit={int(limit)}" if limit else path))
        for job in jobs[: int(limit) if limit else None]:
            yield (json.dumps(job),)
