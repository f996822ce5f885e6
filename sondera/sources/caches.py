"""Caches of per-image results that grow run by run: what is done is not done again, what failed is kept with its reason, and a cache
made with other settings is refused."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import file_exists, write_text
from .sinks import pending

SCHEMA = "semantic-cache-1"


def stored_settings(spark: SparkSession, path: str) -> dict | None:
    if not file_exists(spark, f"{path}/settings.json"):
        return None
    return json.loads(spark.read.text(f"{path}/settings.json", wholetext=True).first()[0])


def update(spark: SparkSession, path: str, rows: DataFrame, key: str, settings: dict, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache after the rows that it lacks have been worked on. work gives rows with the key, their result, and the reason of those that
    failed; both kinds are stored by one committed write, so that an interrupted run leaves nothing half done. Settings must be those of
    the runs before."""
    now = {"schema": SCHEMA} | settings
    before = stored_settings(spark, path)
    if before is None:
        write_text(spark, f"{path}/settings.json", json.dumps(now, sort_keys=True))
    elif before != json.loads(json.dumps(now)):
        different = sorted(k for k in before.keys() | now.keys() if before.get(k) != json.loads(json.dumps(now)).get(k))
        raise ValueError(f"the cache was made with other settings ({', '.join(different)}): use a new folder")
    table = f"{path}/results"
    todo = pending(rows, spark.read.parquet(table), [key]) if file_exists(spark, table) else rows
    work(todo).write.mode("append").parquet(table)
    return spark.read.parquet(table)
