"""Notes as a stream: new and changed files are parsed batch by batch into a table of the latest notes."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.functions.text import percent_decoded
from quire.model import NOTES
from quire.sources.snapshot import refresh
from quire.sources.vault import parse


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, modified, text) of files as they appear."""
    base = root if "://" in root else "file://" + os.path.abspath(root)
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
    rel = F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.lit(1 << 20))
    return files.select(percent_decoded(rel).alias("rel_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


class LatestNotes:
    """The latest parse of each note, in versions below a folder; each batch writes one and then points to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> str:
        return os.path.join(self.folder, "current.json")

    def read(self) -> DataFrame:
        schema = StructType.fromDDL(NOTES)
        try:
            with open(self._pointer(), encoding="utf-8") as f:
                return self.spark.read.schema(schema).parquet("file://" + json.load(f)["path"])
        except FileNotFoundError:
            return self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        newest = Window.partitionBy("rel_path").orderBy(F.col("modified").desc())
        rows = batch.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
        path = os.path.join(self.folder, f"version-{batch_id:09d}-{uuid.uuid4().hex}")
        refresh(self.read(), parse(rows)).write.parquet("file://" + path)
        with open(self._pointer() + ".new", "w", encoding="utf-8") as f:
            json.dump({"path": path, "batch": batch_id}, f)
        os.replace(self._pointer() + ".new", self._pointer())

    def follow(self, files: DataFrame, once: bool = False) -> StreamingQuery:
        os.makedirs(self.folder, exist_ok=True)
        writer = files.writeStream.foreachBatch(self.merge).option("checkpointLocation", "file://" + os.path.join(self.folder, "progress"))
        return (writer.trigger(availableNow=True) if once else writer).start()
