"""All queries of the library: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Run, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its name, with the DuckDB SQL of the same rows where SQL can express them."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = (run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Import every module of plans, which registers its queries."""
    import importlib
    import pkgutil

    from locusframe import plans

    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"locusframe.plans.{module}")


