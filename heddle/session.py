"""SparkSession settings used by tests, the benchmark and the examples."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

#: What a local session has; one that is submitted keeps its submitter's settings.
LOCAL = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}
#: What results or disk depend on, wherever it runs; a setting that is given wins.
EVERYWHERE = {"spark.sql.session.timeZone": "UTC", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def session(app: str = "heddle", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session of the submitter's if there is one (spark-submit, PYSPARK_SUBMIT_ARGS), else a local one."""
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" in os.environ or "PYSPARK_SUBMIT_ARGS" in os.environ:
        SparkContext._ensure_initialized()
        given = SparkConf()
        return builder.config(map={k: v for k, v in (EVERYWHERE | conf).items() if not given.contains(k)}).getOrCreate()
    return builder.master(f"local[{cores}]").config(map=LOCAL | EVERYWHERE | conf).getOrCreate()
