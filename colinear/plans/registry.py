"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colinear.plans import forms, heavy
from colinear.plans import queries as native


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return native.QUERIES | heavy.QUERIES | forms.QUERIES


def oracle_sql() -> dict[str, str]:
    return native.SQL | heavy.SQL | forms.SQL
