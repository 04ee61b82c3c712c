"""Reading the tables of a data folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is not among ``taken``, whatever the case."""
    used = {c.lower() for c in taken}
    name = f"_{name}"
    while name in used:
        name += "_"
    return name


def dealt_anew(totals: DataFrame, keys: Iterable[str], count: str) -> DataFrame:
    """``totals``, a row per group, for a join with the rows of the groups.

    The keys stand behind a condition that always holds (``count`` is over 0)
    but that the optimizer does not see through.  So it deals both sides out
    for the join, in place of reusing how they were dealt out for the totals,
    and adaptive execution can split the rows of a large group.
    """
    return totals.withColumns({k: F.when(F.col(count) > 0, F.col(k)) for k in keys})
