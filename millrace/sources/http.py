"""A data source that fetches documents, one partition an address."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.timeout = float(options.get("timeout", "30"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        from urllib.request import urlopen

        try:
            with urlopen(partition.value, timeout=self.timeout) as answer:
                yield partition.value, answer.read().decode("utf-8", "replace"), None
        except Exception as e:  # an address that fails is a row, so the others come through
            yield partition.value, None, f"{type(e).__name__}: {e}"


class Documents(DataSource):
    """``spark.read.format("documents").option("urls", "u1 u2").load()``"""

    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return "url string, body string, error string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)


class AllSourcesFailed(RuntimeError):
    """Every source failed and nothing came."""


def checked(failures: list, rows: int) -> None:
    """Raise if there were failures and no rows at all."""
    if failures and not rows:
        raise AllSourcesFailed("; ".join(map(str, failures)))
