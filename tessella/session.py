"""The engine's SparkSession."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessella", **conf: str) -> SparkSession:
    """A session with the engine's settings; a cluster's own (master, memory, spark.checkpoint.dir) come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextlib.contextmanager
def timer(label: str = "", say=print):
    """Says how long its block took."""
    begin = time.perf_counter()
    try:
        yield
    finally:
        say(f"{label}: {time.perf_counter() - begin:.3f} s")
