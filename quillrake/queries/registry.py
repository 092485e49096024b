"""A register of named queries: functions of (spark, sf_dir), with the DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracle[f.__name__] = oracle
            return f

        return put

    def sql(self, name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = TABLES) -> None:
        """A query that is Spark SQL over the tables it names; the oracle is the same text unless given."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in tables:
                if t in text:
                    table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(text)

        run.__name__ = name
        self.queries[name] = run
        self.oracle[name] = oracle or text
