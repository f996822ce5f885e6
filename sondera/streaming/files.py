"""State per source file: new files are encoded and appended, unchanged ones skipped, changed ones refused into a report.

Listings (path, size, modified) arrive as a stream, one for each look at the source folder. For each path the size and time at its
first sight are the record, kept in keyed state: a file that is seen with others later has changed since its features were
made, and is refused. The state is in the query's checkpoint, so that a stopped run goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

LISTING = "path string, size long, modified long"
DECISION = f"{LISTING}, decision string"
RECORD = "size long, modified long"


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    record = state.get if state.exists else None
    for frame in frames:
        decisions = []
        for size, modified in zip(frame["size"], frame["modified"]):
            if record is None:
                record = (int(size), int(modified))
                decisions.append("new")
            else:
                decisions.append("unchanged" if record == (int(size), int(modified)) else "changed")
        yield frame.assign(decision=decisions)[["path", "size", "modified", "decision"]]
    if record is not None:
        state.update(record)


def decisions(listings: DataFrame) -> DataFrame:
    """Adds what to do to each row of a stream of listings. Rows of one path within a micro-batch are taken as they come: a listing
    names a path once."""
    ship(listings.sparkSession)
    rows = listings.selectExpr("path", "CAST(size AS LONG) AS size", "CAST(modified AS LONG) AS modified").where("path IS NOT NULL AND size IS NOT NULL AND modified IS NOT NULL")
    return rows.groupBy("path").applyInPandasWithState(_decide, DECISION, RECORD, "append", GroupStateTimeout.NoTimeout)


def decided(listings: DataFrame, batch: str) -> DataFrame:
    """The same for a table of listings numbered by a batch column: what a stream of those batches would have decided."""
    first = Window.partitionBy("path").orderBy(batch)
    same = (F.col("size") == F.first("size").over(first)) & (F.col("modified") == F.first("modified").over(first))
    decision = F.when(F.row_number().over(first) == 1, "new").when(same, "unchanged").otherwise("changed")
    return listings.withColumn("decision", decision)


def follow(listings: DataFrame, encode: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream: features of new files go to output/features, refused files to output/changed, a folder per micro-batch, which a
    batch that is run again replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            encode(batch.where("decision = 'new'")).write.mode("overwrite").parquet(f"{output}/features/batch={number}")
            batch.where("decision = 'changed'").write.mode("overwrite").parquet(f"{output}/changed/batch={number}")
        finally:
            batch.unpersist()

    writer = decisions(listings).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
