"""Records of a commit log: batch files, typed projection, upserts as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import at_uri_did, at_uri_rkey

COMMIT = "did string, kind string, time_us long, commit struct<operation: string, collection: string, rkey: string, record: string, cid: string, rev: string>"


def read_records(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """(did, collection, rkey, uri, record JSON) of a folder of JSON lines {uri, value}."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.uri").alias("uri"), F.get_json_object("value", "$.value").alias("record")).where("uri is not null")
    return rows.select(at_uri_did(F.col("uri")).alias("did"), F.lit(collection).alias("collection"), at_uri_rkey(F.col("uri")).alias("rkey"), "uri", "record")


def as_commit_events(records: DataFrame, time_us: int = 0) -> DataFrame:
    """Batch records as ``create`` commits, so that batch and stream share one path."""
    return records.select("did", "collection", "rkey", "uri", F.lit("create").alias("operation"), F.lit(time_us).cast("long").alias("time_us"), F.lit("").alias("rev"), "record")


def parse_commit_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Commits from JSON lines; lines that aren't commits, or lack a did or a time, are dropped."""
    raw = F.from_json(F.col(column), COMMIT.replace("record: string", "record: string"))
    rows = lines.select(raw.alias("e"), F.get_json_object(column, "$.commit.record").alias("record")).where("e.did is not null and e.time_us is not null and e.kind = 'commit'")
    uri = F.concat(F.lit("at://"), F.col("e.did"), F.lit("/"), F.col("e.commit.collection"), F.lit("/"), F.col("e.commit.rkey"))
    return rows.select(F.col("e.did").alias("did"), F.col("e.commit.collection").alias("collection"), F.col("e.commit.rkey").alias("rkey"), uri.alias("uri"), F.col("e.commit.operation").alias("operation"), F.col("e.time_us").alias("time_us"), F.coalesce("e.commit.rev", F.lit("")).alias("rev"), "record")


def route_commits(commits: DataFrame, collections: list[str], guarded: list[str] = (), trusted_did: str | None = None) -> DataFrame:
    """Commits of known collections; guarded collections only from the trusted did."""
    rows = commits.where(F.col("collection").isin(*collections))
    return rows.where(~F.col("collection").isin(*guarded) | (F.col("did") == trusted_did)) if guarded else rows


def newest_commits(commits: DataFrame, key: str = "uri") -> DataFrame:
    """The newest commit of each key by (time_us, rev)."""
    rest = [c for c in commits.columns if c != key]
    best = commits.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("time_us", "rev")).alias("c"))
    return best.select(key, *[F.col(f"c.{c}").alias(c) for c in rest])


def latest_state(commits: DataFrame, key: str = "uri") -> DataFrame:
    """What remains after all commits."""
    return newest_commits(commits, key).where("operation <> 'delete'")


def upsert(old: DataFrame, commits: DataFrame, key: str = "uri") -> DataFrame:
    """The snapshot ``old`` (with time_us and rev) after a batch: newer rows replace, tombstones remove, late ones don't count."""
    both = old.withColumn("operation", F.lit("create")).unionByName(commits.select(*old.columns, "operation"))
    return latest_state(both, key).select(*old.columns)


def merge_columns(old: DataFrame, new: DataFrame, key: str, rules: dict) -> DataFrame:
    """Rows merged by key with a rule per column: ``overwrite``, ``coalesce`` (new, else old), ``sticky`` (the larger),
    or (``keep_if``, v): the old value stays if the new one is null or v."""
    n, o = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns]), old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns])
    rows = o.join(n, F.col(f"_o_{key}") == F.col(f"_n_{key}"), "full")
    out = [F.coalesce(f"_n_{key}", f"_o_{key}").alias(key)]
    for c, rule in rules.items():
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if rule == "overwrite":
            value = F.when(F.col(f"_n_{key}").isNotNull(), b).otherwise(a)
        elif rule == "coalesce":
            value = F.coalesce(b, a)
        elif rule == "sticky":
            value = F.greatest(F.coalesce(a, b), F.coalesce(b, a))
        else:
            value = F.when(b.isNull() | (b == rule[1]), F.coalesce(a, b)).otherwise(b)
        out.append(value.alias(c))
    return rows.select(*out)


def project_records(rows: DataFrame, schema: str, keep: list[str]) -> DataFrame:
    """Typed columns of the JSON in ``record``; what doesn't parse is null."""
    return rows.select(*keep, F.from_json("record", schema).alias("r")).select(*keep, "r.*")


def payload_cap(rows: DataFrame, column: str, most: int) -> DataFrame:
    """``column`` left out of rows whose value takes more than ``most`` bytes."""
    return rows.withColumn(column, F.when(F.octet_length(column) <= most, F.col(column)))


def stream_max_age(commits: DataFrame, now_us: int, hours: int = 72) -> DataFrame:
    return commits.where(F.col("time_us") >= now_us - hours * 3_600_000_000)


def replace_links(old: DataFrame, records: DataFrame, key: str, items: str, name: str) -> DataFrame:
    """Links (key, name): a record's list replaces its links, without repeats; records without a list leave theirs."""
    listed = records.where(F.col(items).isNotNull())
    kept = old.join(listed.select(key), key, "left_anti").select(key, name)
    return kept.union(listed.select(key, F.explode(F.array_distinct(items)).alias(name)))
