"""Registry of queries: a Spark job and, where one exists, the SQL that must agree with it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import DEFAULTS, materialize
from . import views

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
# Output types both engines print alike: s text, l integer, f double, b 0/1.
_SPARK = {"s": "string", "l": "bigint", "f": "double", "b": "int"}
_SQL = {"s": "varchar", "l": "bigint", "f": "double", "b": "integer"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[["Data"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Data:
    """The given tables and the views derived from them, for one directory."""

    _tables: dict[tuple[str, str, str], DataFrame] = {}
    _stored: dict[tuple[str, str, str], DataFrame] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for key, value in DEFAULTS.items():
            spark.conf.set(key, value)

    def table(self, name: str) -> DataFrame:
        """One given table; its schema is read once per session and directory."""
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in self._tables:
            self._tables[key] = self.spark.read.parquet(os.path.join(self.path, f"{name}.parquet"))
        return self._tables[key]

    def sql(self, text: str, names: tuple[str, ...]) -> DataFrame:
        everything = " ".join((text, *views.chain(names)))
        for name in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", everything)).intersection(TABLES):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(views.with_views(text, names, "spark"))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}", (name,))

    def stored(self, name: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A derived table written once per session and directory, as a real input would be."""
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in self._stored:
            self._stored[key] = materialize(build() if build else self.view(name), name)
        return self._stored[key]

    def entries(self) -> DataFrame:
        """Composed voucher entries."""
        from ..operators.vouchers import compose_vouchers

        return self.stored("entries", lambda: compose_vouchers(self.classified(), self.view("accounts")))

    def classified(self) -> DataFrame:
        """Transactions with the subject that the rules give them; grouping reads them several times."""
        from ..operators.similarity import classify

        return self.stored("classified", lambda: classify(self.view("txn"), self.rules()))

    def rules(self) -> DataFrame:
        """The rule view in the shape the classifier expects ('' = no condition)."""
        return self.sql(
            "SELECT cast(ord as bigint) ord, rule_id, direction, cast(priority as bigint) priority, kw AS keywords, "
            "filter(excl, x -> x <> '') AS exclude, filter(req, x -> x <> '') AS `require`, "
            "cp AS counterparty_pattern, code, name FROM rules", ("rules",),
        )


def register(name: str, columns: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query.  ``columns`` is "name:type ..."; ``sql`` may use the views in ``uses``."""
    spec = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())

    def add(build: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        full = None
        if sql is not None:
            cols = ", ".join(f"cast({c} AS {_SQL[t]}) AS {c}" for c, t in spec)
            full = views.with_views(f"SELECT {cols} FROM ({sql}) AS answer", uses, "duckdb")
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, spec, build, full)
        return build

    return add


def run(query: Query, spark: SparkSession, path: str) -> DataFrame:
    df = query.build(Data(spark, path))
    return df.select(*(df[c].cast(_SPARK[t]).alias(c) for c, t in query.columns))
