"""Read queries: talks with their people, comments, posts and concepts as relations.

List views never select wide columns, so Parquet skips them. Joins tolerate
missing partners, since records arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import is_emoji_reaction


def talks_with_speakers(talks: DataFrame, links: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each talk with its speakers' names, sorted; talks without speakers stay with an empty list."""
    names = links.join(speakers.select(F.col("uri").alias("speaker_uri"), "name"), "speaker_uri").groupBy("talk_uri").agg(F.sort_array(F.collect_list("name")).alias("speakers"))
    return talks.join(names, talks.uri == names.talk_uri, "left").drop("talk_uri").withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))


def talk_detail(talks: DataFrame, links: DataFrame, speakers: DataFrame, talk_concepts: DataFrame, concepts: DataFrame, uri=None) -> DataFrame:
    """Talks (all, or one) with speakers and distinct concept names."""
    one = talks if uri is None else talks.where(F.col("uri") == uri)
    keep = one.select(F.col("uri").alias("talk_uri"))
    named = talk_concepts.join(keep, "talk_uri", "left_semi").join(concepts.select(F.col("uri").alias("concept_uri"), "name"), "concept_uri")
    lists = named.groupBy("talk_uri").agg(F.sort_array(F.collect_set("name")).alias("concepts"))
    rows = talks_with_speakers(one, links.join(keep, "talk_uri", "left_semi"), speakers)
    return rows.join(lists, rows.uri == lists.talk_uri, "left").drop("talk_uri").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def entity_talks(links: DataFrame, talks: DataFrame, entity: str) -> DataFrame:
    """(entity, place, uri, title): an entity's talks in order of start."""
    rows = links.select(entity, "talk_uri").distinct().join(talks.select(F.col("uri").alias("talk_uri"), "title", "starts_at"), "talk_uri")
    place = F.row_number().over(W.partitionBy(entity).orderBy(F.col("starts_at").asc_nulls_first(), "talk_uri"))
    return rows.select(entity, place.alias("place"), F.col("talk_uri").alias("uri"), "title")


def comments_by_talk(comments: DataFrame, talks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(uri, talk_uri): a comment's subject is a talk or its transcript (uri, talk_uri). One equi-join each, no OR."""
    tr = transcripts.select(F.col("uri").alias("subject_uri"), F.col("talk_uri").alias("_talk"))
    rows = comments.join(tr, "subject_uri", "left").withColumn("talk_uri", F.coalesce("_talk", "subject_uri"))
    return rows.join(talks.select(F.col("uri").alias("talk_uri")), "talk_uri", "left_semi").drop("_talk")


def with_authors(rows: DataFrame, profiles: DataFrame, author: str = "author", fallback: Column | None = None) -> DataFrame:
    """Rows with the author's handle from the profiles, else ``fallback``."""
    p = profiles.select(F.col("did").alias(author), F.col("handle").alias("_h"))
    return rows.join(p, author, "left").withColumn("handle", F.col("_h") if fallback is None else F.coalesce(F.col("_h"), fallback)).drop("_h")


def mentions_with_threads(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Top-level posts, during-talk ones first, each with its replies as a list in order of time."""
    named = with_authors(mentions, profiles)
    reply = F.struct("offset_ms", "uri", "handle")
    threads = named.where("parent_uri is not null").groupBy(F.col("parent_uri").alias("uri")).agg(F.sort_array(F.collect_list(reply)).alias("thread"))
    top = named.where("parent_uri is null").join(threads, "uri", "left")
    order = F.row_number().over(W.partitionBy("talk_uri").orderBy(F.when(F.col("mention_type") == "during_talk", 0).otherwise(1), "offset_ms", "uri"))
    return top.select("talk_uri", order.alias("place"), "uri", "handle", F.coalesce(F.transform("thread", lambda t: t["uri"]), F.array().cast("array<bigint>")).alias("replies"))


def attach_one_title(rows: DataFrame, talks: DataFrame, key: str, talk_key: str = "rkey") -> DataFrame:
    """The title of the talk with the smallest uri for a key that may not be unique."""
    titles = talks.groupBy(F.col(talk_key).alias(key)).agg(F.min_by("title", "uri").alias("talk_title"))
    return rows.join(titles, key, "left")


def missing_profiles(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    return posts.select(F.col("author").alias("did")).distinct().join(profiles.select("did"), "did", "left_anti")


def reaction_summary(comments: DataFrame, top: int = 3) -> DataFrame:
    """Per subject: its ``top`` emoji with counts (ties by code point), and the number of other comments."""
    emoji = is_emoji_reaction(F.col("text"))
    counts = comments.where(emoji).groupBy("subject_uri", F.trim("text").alias("emoji")).agg(F.count("*").alias("n"))
    best = counts.groupBy("subject_uri").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "emoji"))), 1, top).alias("s"))
    others = comments.where(~emoji).groupBy("subject_uri").agg(F.count("*").alias("comments"))
    rows = best.join(others, "subject_uri", "full")
    return rows.select("subject_uri", F.transform("s", lambda x: F.concat(x["emoji"], F.lit(":"), (-x["minus"]).cast("string"))).alias("reactions"), F.coalesce("comments", F.lit(0)).cast("long").alias("comments"))


def whole_talk_reactions(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("byte_start").isNull() & is_emoji_reaction(F.col("text"))).groupBy("subject_uri", "text").agg(F.count("*").alias("n"))


def discussion_stats(posts: DataFrame) -> DataFrame:
    top = posts.where("parent_uri is null")
    return top.agg(F.count("*").alias("posts"), F.count_if(F.col("content_type") == "blog").alias("blogs"), F.count_if(F.col("content_type") == "video").alias("videos"), F.countDistinct("author").alias("authors"))


def top_posts(posts: DataFrame, kind: str | None = "post", n: int = 200, blocked: tuple = ()) -> DataFrame:
    """Top-level posts of a class by likes; blocked authors go before the limit. A top-k, not a full sort."""
    rows = posts.where("parent_uri is null")
    if kind is not None:
        same = F.col("content_type") == kind
        rows = rows.where(same | F.col("content_type").isNull() if kind == "post" else same)
    if blocked:
        rows = rows.where(~F.col("author").isin(*blocked))
    return rows.orderBy(F.desc("likes"), "uri").limit(n)


SECTIONS = ["post", "blog", "video", "photo"]


def discussion_feed(posts: DataFrame, first: int = 20) -> DataFrame:
    """(section, place, uri): the ``first`` posts, then the other classes, then the remaining posts; by likes."""
    rows = posts.where("parent_uri is null")
    place = F.row_number().over(W.partitionBy("content_type").orderBy(F.desc("likes"), "uri"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("content_type"))
    ranked = rows.withColumns({"_place": place, "_rank": rank})
    rest = (F.col("content_type") == "post") & (F.col("_place") > first)
    return ranked.select(F.when(rest, len(SECTIONS) + 1).otherwise(F.col("_rank")).cast("int").alias("section"), F.when(rest, F.col("_place") - first).otherwise(F.col("_place")).alias("place"), "uri")


def merged_concept_talk_counts(talk_concepts: DataFrame, merges: DataFrame) -> DataFrame:
    """Distinct talks of each canonical concept; ``merges``: (concept_uri, canonical)."""
    rows = talk_concepts.join(merges, "concept_uri", "left").withColumn("canonical", F.coalesce("canonical", "concept_uri"))
    return rows.groupBy("canonical").agg(F.countDistinct("talk_uri").alias("talks"))


def talk_count_histogram(counts: DataFrame) -> DataFrame:
    n = F.col("talks")
    label = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").otherwise(">10")
    return counts.groupBy(label.alias("bucket")).agg(F.count("*").alias("concepts"))


def cluster_rollup(members: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, total, concepts array of (canonical, name, talks), most talks first); ``members``: (cluster, canonical)."""
    rows = members.distinct().join(names, "canonical").join(counts, "canonical", "left").withColumn("talks", F.coalesce("talks", F.lit(0)))
    one = F.struct((-F.col("talks")).alias("minus"), "canonical", "name")
    out = rows.groupBy("cluster").agg(F.sum("talks").alias("total"), F.sort_array(F.collect_list(one)).alias("c"))
    return out.select("cluster", "total", F.transform("c", lambda x: F.concat_ws("|", x["canonical"].cast("string"), x["name"], (-x["minus"]).cast("string"))).alias("concepts"))


def union_posts(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Several searches as one; the first occurrence of each uri stays, with its search's label."""
    rows = None
    for k, (label, df) in enumerate(parts):
        one = df.withColumns({"search": F.lit(label), "_k": F.lit(k)})
        rows = one if rows is None else rows.unionByName(one)
    place = F.row_number().over(W.partitionBy("uri").orderBy("_k"))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p", "_k")


def flatten_threads(posts: DataFrame) -> DataFrame:
    """Replies to depth 2, linked to the top post: (top, depth, uri)."""
    top = posts.where("parent_uri is null").select(F.col("uri").alias("top"))
    one = posts.select(F.col("parent_uri").alias("top"), "uri").join(top, "top", "left_semi")
    two = one.select("top", F.col("uri").alias("_p")).join(posts.select(F.col("parent_uri").alias("_p"), "uri"), "_p")
    return one.select("top", F.lit(1).alias("depth"), "uri").union(two.select("top", F.lit(2), "uri"))


def time_window_match(talks: DataFrame, vods: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(uri, vod_uri, offset_s, covered_s, confidence): recordings of the room that run at the talk's start; the one
    that covers most is primary. Talks without one have confidence 0.

    A recording is dealt to the hours it runs in, a talk to its starting hour, so
    the join is on (room, hour) and no room meets all its recordings. Talks of one
    room and time are settled once, and of recordings of one room and time the
    largest counts, so an hour holds at most its distinct times.
    """
    v = vods.groupBy("room", "created_at", "duration_s").agg(F.max("vod_uri").alias("vod_uri"))
    v = v.select("vod_uri", "room", (F.col("created_at") - F.make_dt_interval(secs=F.col("duration_s"))).alias("v_start"), F.col("created_at").alias("v_end"))
    hour = F.sequence(F.floor(F.unix_timestamp("v_start") / bucket_s), F.floor(F.unix_timestamp("v_end") / bucket_s))
    v = v.withColumn("_hour", F.explode(hour))
    times = talks.select("room", "starts_at", "ends_at").distinct().withColumn("_hour", F.floor(F.unix_timestamp("starts_at") / bucket_s))
    hits = times.join(v, ["room", "_hour"]).where((F.col("v_start") <= F.col("starts_at")) & (F.col("starts_at") < F.col("v_end")))
    offset = F.unix_timestamp("starts_at") - F.unix_timestamp("v_start")
    covered = F.unix_timestamp(F.least("v_end", "ends_at")) - F.unix_timestamp("starts_at")
    found = hits.withColumns({"offset_s": offset, "covered_s": covered}).groupBy("room", "starts_at", F.col("ends_at").alias("_e")).agg(F.max(F.struct("covered_s", "vod_uri", "offset_s")).alias("b"))
    named = talks.join(found, ["room", "starts_at"]).where(F.col("ends_at").eqNullSafe(F.col("_e")))
    best = named.groupBy("uri").agg(F.max("b").alias("b"))
    return talks.select("uri").join(best, "uri", "left").select("uri", "b.vod_uri", "b.offset_s", "b.covered_s", F.when(F.col("b").isNull(), 0.0).otherwise(0.7).alias("confidence"))


def boundary_score(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(verified, passed, missed, accuracy, mae, mae_found): misses count in accuracy and add nothing to mae's sum."""
    rows = truth.where("verified").join(found, "doc_id", "left")
    error = F.abs(F.col("found_s") - F.col("start_s"))
    ok = F.coalesce(error <= F.col("tolerance_s"), F.lit(False))
    return rows.agg(
        F.count("*").alias("verified"), F.count_if(ok).alias("passed"), F.count_if(error.isNull()).alias("missed"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"), F.round(F.sum(F.coalesce(error, F.lit(0.0))) / F.count("*"), 6).alias("mae"), F.round(F.avg(error), 6).alias("mae_found")
    )


def alignment_flags(rows: DataFrame) -> DataFrame:
    """Flags from the ratio of video to scheduled seconds and from the offset: (uri, flags)."""
    ratio = F.col("video_s") / F.col("scheduled_s")
    flags = F.array(
        F.when(ratio < 0.3, "WRONG_VOD"),
        F.when((ratio >= 0.3) & (ratio < 0.7), "SHORT"),
        F.when(ratio > 2, "MULTI_TALK"),
        F.when(F.col("offset_s") > 120, "BIG_OFFSET"),
    )
    return rows.select("uri", F.array_compact(flags).alias("flags"))


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def filter_talks(talks: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the title or of a speaker's name."""
    low = text.lower()
    return talks.where(F.lower("title").contains(low) | F.exists("speakers", lambda s: F.lower(s).contains(low)))


def filter_terms(terms: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular expression on ``term``; a bad one is taken as plain text."""
    import re

    try:
        re.compile(pattern)
        return terms.where(F.col("term").rlike(f"(?i){pattern}"))
    except re.error:
        return terms.where(F.lower("term").contains(pattern.lower()))


def local_day(ts: Column, hours: int = -7) -> Column:
    """The date at a fixed offset from UTC."""
    return F.to_date(ts + F.make_dt_interval(hours=F.lit(hours)))


def stale_profiles(profiles: DataFrame, fetched: str, now: Column, hours: int = 24) -> DataFrame:
    return profiles.where(F.col(fetched).isNull() | (F.col(fetched) < now - F.make_dt_interval(hours=F.lit(hours))))


def distinct_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct host names; bad addresses are dropped."""
    return urls.select(F.try_parse_url(url, F.lit("HOST")).alias("host")).where("host is not null").distinct()
