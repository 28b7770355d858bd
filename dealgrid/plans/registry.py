"""Registered queries: each one binds an operator to the given tables, with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealgrid.plans.present import present
from dealgrid.plans.oracle_views import ORACLE_VIEWS
from dealgrid.plans.views import BASE_TABLES, VIEWS
from dealgrid.session import cut_lineage

#: Bytes of table files for each shuffle partition; Spark joins small ones again.
PARTITION_BYTES = 8 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id"}
ALL_VIEWS = {**VIEWS, **ORACLE_VIEWS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in ALL_VIEWS:
        if name not in seen and re.search(rf"\b(from|join)\s+{name}\b", sql, re.I):
            _needed(ALL_VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, skip: str | None = None) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    names = [n for n in _needed(sql, []) if n != skip]
    ctes = [f"{n} as ({ALL_VIEWS[n].strip()})" for n in names]
    body = sql.strip()
    if not ctes:
        return body
    match = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if match:
        head = "with recursive " if match.group(1) else "with "
        return head + ",\n".join(ctes) + ",\n" + body[match.end():]
    return "with " + ",\n".join(ctes) + "\n" + body


class Tables:
    """The given tables and the registry views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset(INITIAL_PARTITIONS)
        self._sizes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._split_by_size(name, df)
            return self._widened(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def _split_by_size(self, name: str, df: DataFrame) -> None:
        """Shuffles start from partitions in proportion to the tables read, so that a task's share doesn't grow with them."""
        self._sizes[name] = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = sum(self._sizes.values()) // PARTITION_BYTES
        if wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            self.spark.conf.set(INITIAL_PARTITIONS, str(wanted))

    def _widened(self, df: DataFrame, key: str) -> DataFrame:
        """Spread a long-text table of fewer splits than cores; a larger one is read as it lies."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

    def landed(self, name: str) -> DataFrame:
        """A view written to the shared folder, for queries that read it several times."""
        return cut_lineage(getattr(self, name), name)

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        used = {t: getattr(self, t) for t in BASE_TABLES if "{" + t + "}" in full}
        return self.spark.sql(full, **used)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with the SQL that must agree with it."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.area = fn.__module__.rsplit("q_", 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            for table in BASE_TABLES:
                text = text.replace("{" + table + "}", table)
            text = text.replace("sha2(", "sha256(").replace(", 256)", ")")
            ORACLES[name] = text
        return fn

    return wrap
