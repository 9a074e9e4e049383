"""Edits of talks replayed as aggregates: no list is folded, and no edit scans the talks.

A talk lives from its birth (the base, an add, a split) to the next removal of
its key. Each edit finds the living talk of its key by one as-of join; what holds
at the end is the value of the last edit of its kind. A talk split off begins
with what its origin had at that moment; chains of splits are resolved by
doubling, so their number of joins is the logarithm of the longest chain.

A key names one talk at a time; it may be used again once that talk is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.files import written

from .intervals import as_of

EDIT_SCHEMA = "stream string, seq long, kind string, talk string, edge string, at_s double, end_s double, text string"
BASE = -(1 << 62)


def speaker_names(edits: DataFrame) -> DataFrame:
    """(stream, speaker, name): the last name given to each speaker."""
    named = edits.where("kind = 'name'")
    return named.groupBy("stream", F.col("talk").alias("speaker")).agg(F.max_by("text", "seq").alias("name"))


def _births(talks: DataFrame, edits: DataFrame) -> DataFrame:
    """(stream, talk, birth, title, start_s, end_s, confidence, origin, gone): every talk that ever was, with the removal that ends it."""
    none = F.lit(None).cast("string")
    base = talks.select("stream", "talk", F.lit(BASE).alias("birth"), "title", "start_s", "end_s", "confidence", none.alias("origin"))
    adds = edits.where("kind = 'add'").select("stream", "talk", F.col("seq").alias("birth"), F.col("text").alias("title"), F.col("at_s").alias("start_s"), "end_s", F.lit("manual").alias("confidence"), none.alias("origin"))
    splits = edits.where("kind = 'split'").select("stream", F.col("text").alias("talk"), F.col("seq").alias("birth"), F.lit("Untitled").alias("title"), F.col("at_s").alias("start_s"), F.lit(None).cast("double").alias("end_s"), none.alias("confidence"), F.col("talk").alias("origin"))
    removals = edits.where("kind = 'remove'").select("stream", "talk", F.col("seq").alias("gone"))
    return as_of(base.union(adds).union(splits), removals, ["stream", "talk"], "birth", "gone", forward=True)


def _resolved(rows: DataFrame) -> DataFrame:
    """Rows with what they have from their origins: pointers (up) double until none is left; a split without an origin is no talk."""
    while rows.where("up is not null").limit(1).count():
        rows = written(rows, "edits")
        above = rows.select("stream", F.col("me").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "end_s", "confidence", "ord", "path")], F.lit(True).alias("_found"))
        both = rows.join(above, ["stream", "up"], "left").where("up is null or _found")
        far = F.col("up").isNotNull() & F.col("ord").isNull()
        rows = both.select(
            "stream", "me", "talk", "birth", "gone", F.col("_up").alias("up"), "title", "start_s", F.coalesce("end_s", "_end_s").alias("end_s"), F.coalesce("confidence", "_confidence").alias("confidence"),
            F.coalesce("ord", "_ord").alias("ord"), F.when(far, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
        )
    return rows


def replay_corrections(talks: DataFrame, edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """(stream, place, talk, title, start_s, end_s, confidence, verified) after the edits up to ``cursor`` (a count).

    ``edits`` as EDIT_SCHEMA: move (edge, at_s), split (at_s, text = new key),
    add (text = title, at_s, end_s), remove, title (text), verify, unverify.
    Edits of a stream apply in the order of seq. Talks stand in the order of
    start and key, sorted again at each add; a split-off talk follows its origin.
    Ties go to the older talk, then by key.
    """
    if cursor is not None:
        edits = edits.withColumn("_k", F.row_number().over(W.partitionBy("stream").orderBy("seq"))).where(F.col("_k") <= cursor).drop("_k")
    births = written(_births(talks, edits), "births")
    marks = births.select("stream", "talk", F.col("birth").alias("mark"), F.col("birth").alias("of"), F.col("gone").alias("until"))
    living = lambda points: as_of(points, marks, ["stream", "talk"], "seq", "mark").where("of is not null and (until is null or until > seq)")
    done = written(living(edits.where("kind in ('move', 'title', 'verify', 'unverify', 'split')").select("stream", "talk", "seq", "kind", "edge", "at_s", "text")), "edits")
    ends = done.where("kind = 'split' or (kind = 'move' and edge <> 'start')")
    # the end that an origin had before a split
    splits = done.where("kind = 'split'").select("stream", "talk", "of", (F.col("seq") - 1).alias("before"), F.col("seq").alias("birth"), F.col("text").alias("new"))
    had = as_of(splits, ends.select("stream", "talk", "of", F.col("seq").alias("at"), F.col("at_s").alias("had")), ["stream", "talk", "of"], "before", "at")
    me = lambda talk, birth: F.struct(F.col(talk).alias("talk"), F.col(birth).alias("birth"))
    origins = had.select("stream", me("talk", "of").alias("up"), me("new", "birth").alias("me"), "had")
    sorted_at = edits.where("kind = 'add'").groupBy("stream").agg(F.max("seq").alias("sorted_at"))
    starts = done.where("kind = 'move' and edge = 'start'").join(sorted_at, "stream").where("seq < sorted_at")
    then = starts.groupBy("stream", me("talk", "of").alias("me")).agg(F.max_by("at_s", "seq").alias("then_s"))
    rows = births.withColumn("me", me("talk", "birth")).join(origins, ["stream", "me"], "left").where("origin is null or up is not null").join(sorted_at, "stream", "left").join(then, ["stream", "me"], "left")
    root = F.col("up").isNull() | (F.col("birth") <= F.col("sorted_at"))
    order = F.when(root, F.struct(F.coalesce("then_s", "start_s").alias("at"), F.col("birth").alias("birth"), F.col("talk").alias("talk")))
    path = F.when(root, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(-F.col("birth")))
    rows = _resolved(rows.select("stream", "me", "talk", "birth", "gone", "up", "title", "start_s", F.coalesce("end_s", "had").alias("end_s"), "confidence", order.alias("ord"), path.alias("path"))).where("gone is null")
    last = lambda value, which: F.max_by(F.when(which, value), F.when(which, F.col("seq")))
    kind, edge = F.col("kind"), F.col("edge")
    ended = (kind == "split") | ((kind == "move") & (edge != "start"))
    new = done.groupBy("stream", me("talk", "of").alias("me")).agg(
        last(F.col("at_s"), (kind == "move") & (edge == "start")).alias("_start"), F.count_if((kind == "move") & (edge == "start")).alias("_starts"), last(F.col("at_s"), ended).alias("_end"), F.count_if(ended).alias("_ends"),
        last(F.struct("text"), kind == "title").alias("_title"), last(kind == "verify", kind.isin("verify", "unverify")).alias("_verified"),
    )
    rows = rows.join(new, ["stream", "me"], "left")
    place = F.row_number().over(W.partitionBy("stream").orderBy("ord", "path")).alias("place")
    return rows.select(
        "stream", place, "talk", F.when(F.col("_title").isNotNull(), F.col("_title.text")).otherwise(F.col("title")).alias("title"), F.when(F.col("_starts") > 0, F.col("_start")).otherwise(F.col("start_s")).alias("start_s"),
        F.when(F.col("_ends") > 0, F.col("_end")).otherwise(F.col("end_s")).alias("end_s"), "confidence", F.coalesce("_verified", F.lit(False)).alias("verified"),
    )
