"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quarry", **conf: str) -> SparkSession:
    """A session with UTC as its zone and adaptive execution on; other settings come from the cluster."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
