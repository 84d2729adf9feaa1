"""The session that the engine expects; on a cluster the submitted settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName("quire")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
