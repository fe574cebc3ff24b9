"""The files opened last, and a store of open documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files that the list of recent ones keeps.
RECENT = 20


def recent(opened: DataFrame, n: int = RECENT) -> DataFrame:
    """file, opened, rank: the n files opened last, each once, of rows (file, opened); ties by file. Rows without a file or time are none."""
    last = opened.where("file IS NOT NULL AND opened IS NOT NULL").groupBy("file").agg(F.max("opened").alias("opened"))
    # Spark takes the first n of each partition before the few of all meet in one task.
    first = last.orderBy(F.desc("opened"), "file").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("opened"), "file"))).select("file", "opened", "rank")


class DocumentStore:
    """Open documents by key, as a Parquet table of versions: each put is a new one, and the newest of a key counts.

    The table lies in a folder that driver and executors share; other sessions see what is put at once.
    """

    SCHEMA = "doc_id bigint, content binary, version bigint, open boolean"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def _add(self, rows: DataFrame, content: Column, is_open: bool) -> None:
        version = (self._versions().agg(F.max("version")).first()[0] or 0) + 1
        rows.select("doc_id", content.alias("content"), F.lit(version).cast("long").alias("version"), F.lit(is_open).alias("open")).write.mode("append").parquet(self.folder)

    def put(self, files: DataFrame) -> None:
        """Opens files (doc_id, content), or gives open ones new content."""
        self._add(files, F.col("content"), True)

    def close(self, ids: DataFrame) -> None:
        """Closes documents (doc_id)."""
        self._add(ids, F.lit(None).cast("binary"), False)

    def files(self) -> DataFrame:
        """doc_id, content of the documents that are open."""
        newest = self._versions().groupBy("doc_id").agg(F.max_by(F.struct("content", "open"), "version").alias("now"))
        return newest.where("now.open").select("doc_id", "now.content")
