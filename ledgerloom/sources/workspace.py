"""A workspace: a folder of Parquet tables, each with its fixed schema, read and changed as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import diagnostics, store
from ledgerloom.schemas import TABLES


class Workspace:
    """Tables below one folder; a table that was never written reads as empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return store.current(self.spark, self.path(name)) is not None

    def read(self, name: str) -> DataFrame:
        schema = TABLES[name]
        at = store.current(self.spark, self.path(name))
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        store.append(self._shaped(name, rows), self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        store.replace(self._shaped(name, rows), self.path(name))

    def upsert(self, name: str, rows: DataFrame, key: list[str], order: list[str]) -> None:
        self.replace(name, store.upserted(self.read(name), self._shaped(name, rows), key, order))

    def clear(self, name: str) -> None:
        self.replace(name, self.spark.createDataFrame([], TABLES[name]))

    def delete(self, name: str, key: str, values: list) -> None:
        """The table without the rows of those keys."""
        kind = self.read(name).schema[key].dataType.simpleString()
        self.replace(name, store.without(self.read(name), self.spark.createDataFrame([(v,) for v in values], f"{key} {kind}"), [key]))

    def isolated(self, label: str) -> Workspace:
        """An empty workspace of its own below this one, as a benchmark's variant needs."""
        return Workspace(self.spark, f"{self.folder}/_variants/{label}-{uuid.uuid4().hex[:12]}")

    def copy_family(self, family: str, to: Workspace) -> None:
        """A family's record, members and results in another workspace."""
        for name, df in diagnostics.family_copy({n: self.read(n) for n in TABLES}, family).items():
            to.replace(name, df)

    def record_run(self, results: DataFrame, dataset: str) -> int:
        """Append a run and its invoices; the run's number is its own, also where two end at once."""
        run_id = uuid.uuid4().int >> 65
        run, invoices = diagnostics.run_rows(results, F.lit(run_id))
        shaped = run.select(F.lit(run_id).alias("id"), F.lit(dataset).alias("dataset"), F.current_timestamp().alias("started_at"), F.col("total").alias("total_invoices"), F.col("passed").alias("accepted"), F.col("failed").alias("rejected"), "errors")
        self.append("run_invoices", invoices)
        self.append("runs", shaped)
        return run_id

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
