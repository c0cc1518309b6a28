"""Registry of the checked queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.fixtures import load, with_fixtures
from loomgraph.session import configure, fit_tasks, materialize


class Tables:
    """Driver tables and fixtures of one data folder, by attribute or name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)


    def stored(self, name: str) -> DataFrame:
        """A fixture written as a table first, as an operator's input would be."""
        return materialize(load(self.spark, self.sf_dir, name), name)


Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``.

    ``sql`` may use {fixture} names; ``@<`` and ``>@`` stand for braces.
    """

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = with_fixtures(sql).replace("@<", "{").replace(">@", "}")
        return plan

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The plan as (spark, sf_dir) -> DataFrame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit_tasks(configure(spark), sf_dir)
        return PLANS[name](Tables(spark, sf_dir))

    run.__name__ = name
    return run
