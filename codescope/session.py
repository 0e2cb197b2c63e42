"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "codescope", **settings: str) -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.appName(name).config(map=conf | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
