"""Registered queries: a name, a plan over the record model, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The record model's tables by name, read when they are asked for; raw tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = tables.as_of()

    def __getattr__(self, name: str) -> DataFrame:
        made = getattr(tables, name, None)
        return made(self.spark, self.sf_dir) if made else tables.read(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register a plan; ``raw`` SQL stands alone, other SQL follows the record model's tables."""

    def add(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if raw else tables.DUCK + sql
        return plan

    return add
