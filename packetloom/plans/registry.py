"""A report pairs a Spark plan with the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Report:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Reports(dict):
    def add(self, name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None,
            doubles: Sequence[str] = (), digits: int = 6) -> None:
        """Register; the ``doubles`` columns are rounded on both sides.

        Means of integers often lie exactly between two rounded values, where the order of a sum
        decides; a nudge far above that noise and far below the last digit settles them.
        """
        nudge = 3 * 10.0 ** -(digits + 3)

        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = run(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + F.lit(nudge), digits) for c in doubles}) if doubles else df

        if sql is not None and doubles:
            fixes = ", ".join(f"round({c} + {nudge:e}, {digits}) AS {c}" for c in doubles)
            sql = f"SELECT * REPLACE ({fixes}) FROM (\n{sql}\n)"
        self[name] = Report(rounded, sql)


def with_tables(*parts: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip() for p in parts) + "\n" + select
