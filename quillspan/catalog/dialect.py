"""The two SQL dialects in which derived input tables are written once.

Derived tables turn the given tables into the shapes the operators need (files,
structured texts, manifests, streams).  They grow with the given tables, and each
is one template, so Spark and the oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Spark:
    """Spark SQL over the Parquet files of one directory."""

    TEXT_TABLES = ("documents", "pages")

    def __init__(self, sf_dir: str, spark: SparkSession) -> None:
        self.sf_dir, self.spark = sf_dir, spark

    def table(self, name: str) -> str:
        """The table; text tables with fewer splits than cores are spread before the work on their texts.

        A table of many splits, the normal case on a cluster, is read as it is.
        """
        path = f"{self.sf_dir}/{name}.parquet"
        if name in self.TEXT_TABLES:
            cores = self.spark.sparkContext.defaultParallelism
            if self.spark.read.parquet(path).rdd.getNumPartitions() < cores:
                return f"(SELECT /*+ REPARTITION({cores}) */ * FROM parquet.`{path}`)"
        return f"parquet.`{path}`"

    def split(self, x: str, regex: str) -> str:
        return f"split({x}, {regex})"

    def transform(self, items: str, body) -> str:
        return f"transform({items}, (v, i) -> {body('v', 'i')})"

    def filter(self, items: str, body) -> str:
        return f"filter({items}, v -> {body('v')})"

    def join(self, items: str, sep: str) -> str:
        return f"array_join({items}, {sep})"

    def slice(self, items: str, first: int, last: int) -> str:
        return f"slice({items}, {first}, {last - first + 1})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def unnest(self, source: str, items: str, columns: str) -> str:
        return f"SELECT {columns}, pos, item FROM {source} LATERAL VIEW posexplode({items}) AS pos, item"

    def text(self, x: str) -> str:
        return f"cast({x} AS string)"


class Duck:
    """DuckDB over the registered views."""

    def table(self, name: str) -> str:
        return name

    def split(self, x: str, regex: str) -> str:
        return f"string_split_regex({x}, {regex})"

    def transform(self, items: str, body) -> str:
        return f"list_transform({items}, lambda v, i: {body('v', '(i - 1)')})"

    def filter(self, items: str, body) -> str:
        return f"list_filter({items}, lambda v: {body('v')})"

    def join(self, items: str, sep: str) -> str:
        return f"array_to_string({items}, {sep})"

    def slice(self, items: str, first: int, last: int) -> str:
        return f"list_slice({items}, {first}, {last})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def unnest(self, source: str, items: str, columns: str) -> str:
        return (
            f"SELECT {columns}, idx - 1 AS pos, items[idx] AS item FROM (SELECT *, unnest(range(1, len(items) + 1)) AS idx "
            f"FROM (SELECT *, {items} AS items FROM {source}))"
        )

    def text(self, x: str) -> str:
        return f"cast({x} AS varchar)"
