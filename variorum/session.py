"""Sessions for tools and tests; queries take whatever session they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "variorum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides any setting."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
