"""The commit stream: Structured Streaming over the same code as the batch path.

Each micro-batch is reduced to the newest commit of every uri and written as one
Parquet folder of a log; a batch that runs again overwrites its own folder, so the
stream's checkpoint and the log agree after a restart. The state is the newest
commit of every uri over the log: a batch costs what it brings, not what is there.
``CommitLog.compact`` folds old batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.sources.records import newest_commits, parse_commit_events, route_commits

STATE = "uri string, did string, collection string, rkey string, time_us long, rev string, record string"


def commit_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Commits of a folder of JSON-lines files; the query's checkpoint is the cursor."""
    return parse_commit_events(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


class CommitLog:
    """Newest commits by batch under a folder; tombstones stay as rows with a null record, so that older
    commits that arrive late stay out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.createDataFrame([], STATE).write.mode("ignore").parquet(f"{root}/batch=-1")

    def write(self, commits: DataFrame, batch: int) -> None:
        new = newest_commits(commits.select("uri", "did", "collection", "rkey", "operation", "time_us", "rev", "record"))
        rows = new.select("uri", "did", "collection", "rkey", "time_us", "rev", F.when(F.col("operation") != "delete", F.col("record")).alias("record"))
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self) -> DataFrame:
        """The newest row of every uri."""
        log = self.spark.read.schema(f"{STATE}, batch long").option("basePath", self.root).parquet(self.root)
        return newest_commits(log.drop("batch"))

    def compact(self, root: str) -> CommitLog:
        """A log at ``root`` with all batches so far as one; later batches go on there."""
        self.read().write.mode("overwrite").parquet(f"{root}/batch=-1")
        return CommitLog(self.spark, root)


def stream_index(commits: DataFrame, log: CommitLog, checkpoint: str, collections: list[str], guarded: list[str] = (), trusted_did: str | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the stream into the log; ``after`` gets each routed batch once it is written."""

    def each(batch: DataFrame, number: int) -> None:
        routed = route_commits(batch, collections, guarded, trusted_did)
        log.write(routed, number)
        if after:
            after(routed, number)

    return commits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(state: DataFrame) -> DataFrame:
    """Rows that aren't tombstones."""
    return state.where("record is not null")


def with_cascades(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent hasn't been deleted; children of unknown parents stay, since records come in any order."""
    dead = parents.where("record is null").select(F.col("uri").alias(key))
    return children.join(dead, key, "left_anti")


def affected_expressions(batch: DataFrame, field: str = "$.expression") -> DataFrame:
    """Keys of expressions that a batch's expressions, segmentations or layers touch."""
    own = batch.where(F.col("collection").endswith("expression")).select("uri")
    parts = batch.where(~F.col("collection").endswith("expression")).select(F.get_json_object("record", field).alias("uri"))
    return own.union(parts).where("uri is not null").distinct()


def ready_expressions(state: DataFrame, keys: DataFrame, field: str = "$.expression") -> DataFrame:
    """Of ``keys``, the expressions that are there with a segmentation and a layer at least."""
    rows = live(state)
    there = rows.where(F.col("collection").endswith("expression")).join(keys, "uri", "left_semi").select("uri")
    parts = rows.select(F.get_json_object("record", field).alias("uri"), F.col("collection").endswith("segmentation").alias("s"), F.col("collection").endswith("annotationLayer").alias("a"))
    full = parts.groupBy("uri").agg(F.max("s").alias("s"), F.max("a").alias("a")).where("s and a")
    return there.join(full, "uri", "left_semi")


def new_authors(batch: DataFrame, profiles: DataFrame) -> DataFrame:
    """Authors of a batch without a profile."""
    return batch.select("did").distinct().join(profiles.select("did"), "did", "left_anti")
