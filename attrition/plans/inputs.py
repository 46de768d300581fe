"""Lazily built inputs of the registered queries (plans only; nothing is executed here)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

from ..functions.expressions import q
from ..operators import panel as P
from ..sources import fixtures, tables
from ..sources.staging import stage


class Inputs:
    """Driver tables of one data directory and the attrition frames derived from them."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir

    _tables: dict = {}

    def table(self, name: str) -> DataFrame:
        """The Parquet table (lazy); its footer is read once per application and directory."""
        key = (self.spark.sparkContext.applicationId, self.data_dir, name)
        if key not in Inputs._tables:
            Inputs._tables[key] = tables.read_table(self.spark, self.data_dir, name)
        return Inputs._tables[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in tables.TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def panel(self) -> DataFrame:
        return fixtures.usage_panel(self.table("orders"), self.table("lineitem"), self.table("customer"))

    @cached_property
    def churn_labels(self) -> DataFrame:
        return fixtures.account_label(self.table("orders"))

    @cached_property
    def account_means(self) -> DataFrame:
        return P.account_means(self.panel)

    @cached_property
    def account_table(self) -> DataFrame:
        return P.account_table(self.panel, self.churn_labels)

    @cached_property
    def explore(self) -> DataFrame:
        """Exploratory account frame (months present, cleaned means, label mean)."""
        return P.account_months_means(self.panel, self.churn_labels)

    @cached_property
    def scored(self) -> DataFrame:
        return fixtures.scored_accounts(self.account_means)

    def stored(self, name: str) -> DataFrame:
        """A derived table written once to the shared folder (for analyses that read it many times).

        The same step as saving the account table before profiling it: later
        passes read the columns they need instead of re-running the derivation.
        """
        key = f"_stored_{name}"
        if key not in self.__dict__:
            self.__dict__[key] = stage(getattr(self, name), name)
        return self.__dict__[key]


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column with the tie-safe rule so two engines compare equal."""
    scale = 10 ** digits
    out = []
    for f in df.schema.fields:
        name = q(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(f"floor(CAST({name} AS DOUBLE) * {scale}D + 0.5001D) / {scale}D AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)
