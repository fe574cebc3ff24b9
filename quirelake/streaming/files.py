"""Files that arrive over time: the same stateless kernel over a stream, and running aggregates with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirelake.sources import pdf


def stream_files(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """doc_id, path, modified, length, content of files as they come into a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "length", "content")


def stream_relation(files: DataFrame, name: str, **options) -> DataFrame:
    """A relation of a stream of files: each file's rows depend on it alone, so there is no state."""
    return pdf.relation(files, name, **options)


def arrivals(files: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, files, bytes for each window of modification times; state goes once the watermark is past."""
    return files.withWatermark("modified", late).groupBy(F.window("modified", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select(F.col("window.start").alias("start"), "files", "bytes")


def latest_by_key(events: DataFrame, keys: list[str], order: str, late: str) -> DataFrame:
    """The last row of each key so far (update mode), as revisions of a file are merged."""
    rest = [c for c in events.columns if c not in keys]
    return events.withWatermark(order, late).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


class Revisions(StatefulProcessor):
    """The newest revision of each object: a row goes out when what is known of the object changes."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A tombstone is a state too: a late revision from before a free must not bring the object back.
        self.newest = handle.getValueState("newest", "revision long, freed boolean, value string", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        was = self.newest.get() if self.newest.exists() else None
        now = was
        for batch in rows:
            for revision, freed, value in zip(batch["revision"], batch["freed"], batch["value"], strict=True):
                row = (int(revision), bool(freed), None if freed or pd.isna(value) else str(value))
                # Of rows of one revision a free counts, then the larger value: the same whatever order they come in.
                if now is None or (row[0], row[1], row[2] or "") > (now[0], now[1], now[2] or ""):
                    now = row
        if now is not None and now != was:
            self.newest.update(now)
            yield pd.DataFrame({"doc_id": [key[0]], "obj": [key[1]], "revision": [now[0]], "freed": [now[1]], "value": [now[2]]}).astype({"value": object})

    def close(self) -> None:
        pass


def object_changes(revisions: DataFrame, ttl_hours: int = 0) -> DataFrame:
    """A changelog of objects, in update mode: doc_id, obj, revision, freed, value of each object whose newest revision has changed.

    revisions: doc_id, obj, revision, freed, value. A revision older than the one known changes nothing, so late and
    repeated rows do no harm; a free is a tombstone that an older revision does not undo, and a newer one does. State of
    an object is forgotten ttl_hours after its last change (0: never); rows with a null key or revision are left out.
    """
    spark = revisions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = revisions.where("doc_id IS NOT NULL AND obj IS NOT NULL AND revision IS NOT NULL").select("doc_id", "obj", "revision", F.coalesce("freed", F.lit(False)).alias("freed"), F.col("value").cast("string").alias("value"))
    schema = "doc_id long, obj long, revision long, freed boolean, value string"
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("obj").cast("long").alias("obj"), F.col("revision").cast("long").alias("revision"), "freed", "value")
    return rows.groupBy("doc_id", "obj").transformWithStateInPandas(Revisions(ttl_hours * 3_600_000), schema, "Update", "ProcessingTime" if ttl_hours else "None")


def live_objects(revisions: DataFrame) -> DataFrame:
    """What a batch makes of the same rows: doc_id, obj, revision, value of the objects whose newest revision is no free."""
    rows = revisions.where("doc_id IS NOT NULL AND obj IS NOT NULL AND revision IS NOT NULL").withColumn("freed", F.coalesce("freed", F.lit(False)))
    newest = rows.groupBy("doc_id", "obj").agg(F.max(F.struct("revision", "freed", F.when(~F.col("freed"), F.col("value").cast("string")).alias("value"))).alias("now"))
    return newest.where("NOT now.freed").select("doc_id", "obj", "now.revision", "now.value")
