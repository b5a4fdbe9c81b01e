"""A handle on one tenant: every table it gives out is filtered to that workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import table


class Workspace:
    """Tables of a data folder, of one workspace only. The filter is pushed to the scan."""

    def __init__(self, spark: SparkSession, folder: str, workspace_id: str):
        self.spark, self.folder, self.id = spark, folder, workspace_id

    def table(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        if "workspace_id" not in df.columns:
            raise ValueError(f"{name} has no workspace_id and cannot be scoped")
        return df.where(F.col("workspace_id") == self.id)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def is_scoped(df: DataFrame, workspace_id: str) -> bool:
    """Whether the analysed plan filters by that workspace; the check of the tests."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return "workspace_id" in plan and workspace_id in plan
