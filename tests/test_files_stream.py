"""State per source file, over restarts."""

import json

import pytest

from pyspark.sql import functions as F

from sondera.streaming import files

LISTINGS = [
    [("a", 1, 10), ("b", 2, 10)],
    [("a", 1, 10), ("b", 3, 12), ("c", 5, 11)],
    [("a", 1, 13), ("b", 2, 10), ("c", 5, 11), ("d", 0, 1)],
]


def outcome(spark, out):
    features = sorted(r.path for r in spark.read.parquet(f"file://{out}/features").collect())
    changed = sorted((r.path, r.size, r.modified) for r in spark.read.parquet(f"file://{out}/changed").collect())
    return features, changed


@pytest.mark.parametrize("restarts", [False, True])
def test_restarts_change_nothing(spark, tmp_path, restarts):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    encoded = []

    def encode(rows):
        encoded.append(sorted(r.path for r in rows.select("path").collect()))
        return rows.select("path", F.col("size").cast("double").alias("feature"))

    def run():
        stream = spark.readStream.schema(files.LISTING).option("maxFilesPerTrigger", 1).json(f"file://{inbox}")
        files.follow(stream, encode, f"file://{out}", f"file://{tmp_path}/state").awaitTermination()

    for k, listing in enumerate(LISTINGS):
        (inbox / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("path", "size", "modified"), row))) for row in listing))
        if restarts:
            run()
    if not restarts:
        import os

        for k in range(len(LISTINGS)):  # in the order of their times
            os.utime(inbox / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        run()
    assert outcome(spark, out) == (["a", "b", "c", "d"], [("a", 1, 13), ("b", 3, 12)])
    assert sorted(p for e in encoded for p in e) == ["a", "b", "c", "d"]  # none is encoded twice
    table = spark.createDataFrame([(k, *row) for k, listing in enumerate(LISTINGS) for row in listing], "look int, " + files.LISTING)
    batch = files.decided(table, "look").collect()
    assert sorted(r.path for r in batch if r.decision == "new") == outcome(spark, out)[0]
    assert sorted((r.path, r.size, r.modified) for r in batch if r.decision == "changed") == outcome(spark, out)[1]
