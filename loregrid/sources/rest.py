"""A table in a REST store as a Spark data source, with its filters pushed to the server.

``spark.read.format("rest_table").option("url", …).schema(…).load()``; a path instead of a
URL reads a JSON dump of the rows, which then are filtered here by the same rules.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType


class RestTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_table"

    def schema(self) -> str:
        return "id string, content string, metadata string, created_at string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(self.options, schema)


class RestReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.wanted: list[tuple[str, str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | GreaterThanOrEqual) and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], "eq" if isinstance(f, EqualTo) else "gte", str(f.value)))
            else:
                yield f

    def partitions(self):
        return [InputPartition(0)]

    def _rows(self) -> list[dict]:
        if "url" not in self.options:
            with open(self.options["path"]) as file:
                rows = json.load(file)
            keep = {"eq": lambda a, b: str(a) == b, "gte": lambda a, b: str(a) >= b}
            return [r for r in rows if all(keep[op](r.get(c), v) for c, op, v in self.wanted)]
        query = [("order", "created_at.desc"), *((c, f"{op}.{v}") for c, op, v in self.wanted)]
        if "limit" in self.options:
            query.append(("limit", self.options["limit"]))
        headers = {k[7:]: v for k, v in self.options.items() if k.startswith("header.")}
        request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(query)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                return json.load(answer)
        except OSError:
            return []

    def read(self, partition):
        for r in self._rows():
            yield tuple(json.dumps(v) if isinstance(v := r.get(f.name), dict | list) else None if v is None else str(v) for f in self.schema)


def register(spark: SparkSession) -> None:
    from ..plans.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestTable)
