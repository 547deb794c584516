"""What changed since the last run, and keyed debouncing of change events, on batches or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed(now: DataFrame, before: DataFrame, key: str, *marks: str) -> DataFrame:
    """Rows of `now` whose key and marks (size, time, hash) are not in `before`."""
    on = now[key].eqNullSafe(before[key])
    for m in marks:
        on = on & now[m].eqNullSafe(before[m])
    return now.join(before, on, "left_anti")


def debounced(events: DataFrame, gap: str, key: str, time: str = "ts") -> DataFrame:
    """key, opened, closed, events: one row for each burst of a key's events with pauses shorter than `gap`. Streams need a watermark on `time`."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "events")


FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, glob: str = "*.L5X") -> DataFrame:
    """A stream of project files that appear in the folder or change there."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def merge_edits(before: DataFrame, now: DataFrame, key: str, mark: str) -> DataFrame:
    """key, state: added, removed, changed or same, by a full outer join."""
    a, b = before.select(F.col(key).alias("__a"), F.col(mark).alias("__x")), now.select(F.col(key).alias("__b"), F.col(mark).alias("__y"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__x").eqNullSafe(F.col("__y")), "same").otherwise("changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), state.alias("state"))
