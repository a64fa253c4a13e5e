"""A Python data source for JSON pages over HTTP; each URL is a partition."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


def objects_of(value: object) -> list[dict]:
    """The objects of a response: itself, the members of a list, or of its ``results`` or ``data``."""
    if isinstance(value, dict):
        inner = next((value[k] for k in ("results", "data") if isinstance(value.get(k), list)), None)
        return [value] if inner is None else objects_of(inner)
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


class _Reader(DataSourceReader):
    def __init__(self, urls: Sequence[str], most_bytes: int):
        self.urls, self.most_bytes = urls, most_bytes

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        if not partition.value.startswith(("https://", "file://")):
            raise ValueError("only https URLs and local files are read")
        with urlopen(partition.value, timeout=30) as response:  # noqa: S310
            body = response.read(self.most_bytes + 1)
        if len(body) > self.most_bytes:
            raise ValueError("a response is too large")
        for position, item in enumerate(objects_of(json.loads(body))):
            yield partition.value, position, json.dumps(item, ensure_ascii=False)


class JsonPages(DataSource):
    """Options: ``urls``, a JSON array; ``most_bytes``, the largest response."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "url string, position int, object string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["urls"]), int(self.options.get("most_bytes", 25 << 20)))


def read_json_pages(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """(url, position, object): every object of the JSON behind each URL."""
    spark.dataSource.register(JsonPages)
    return spark.read.format("json_pages").option("urls", json.dumps(list(urls))).load()
