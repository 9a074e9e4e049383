"""Files: transcripts in either shape, curated side tables, annotations by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import at_uri_rkey
from spanloom.functions.timing import encode_signed

TRANSCRIPT = "text string, startMs long, timings array<long>, words array<struct<word: string, start: double, end: double>>"


def read_transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, start_ms, timings) of a folder of JSON files that hold either a list of words with times in
    seconds or text with signed timings. The file's name is the key; times round half up."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    files = raw.select(F.regexp_replace(at_uri_rkey(F.col("_metadata.file_path")), r"\.json$", "").alias("doc_id"), "*")
    compact = files.where("timings is not null").select("doc_id", "text", F.coalesce("startMs", F.lit(0)).alias("start_ms"), "timings")
    ms = lambda c: F.floor(c * 1000 + 0.5)
    words = files.where("timings is null and words is not null").select("doc_id", F.posexplode("words").alias("pos", "w"))
    words = words.select("doc_id", "pos", F.col("w.word").alias("word"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"))
    one = F.sort_array(F.collect_list(F.struct("pos", "word")))
    texts = words.groupBy("doc_id").agg(F.array_join(F.transform(one, lambda x: x["word"]), " ").alias("text"))
    return compact.unionByName(texts.join(encode_signed(words), "doc_id"))


def write_annotations(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """JSON lines in one folder per document."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def read_sidecar_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated JSON file that is one list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_sidecar_map(spark: SparkSession, path: str, field: str, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) of a field of a curated JSON file that holds an object of strings."""
    rows = spark.read.schema(f"{field} map<string, string>").option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias(key, value))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which all executors share; a temporary one only in local mode."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to a new folder of ``scratch_dir`` and read back: several readers share it, lineage ends there."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` marked for broadcast if they are ``most`` or fewer; beyond, joins shuffle. They are counted, so they should be written."""
    return F.broadcast(rows) if rows.count() <= most else rows
