"""Alignment: talks, recordings, posts and speakers matched in time and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import as_of, with_buckets

CONFERENCE_TYPES_OUT = ("info", "food")


def schedule_filter(events: DataFrame, types_out: tuple = CONFERENCE_TYPES_OUT) -> DataFrame:
    """Events that weren't cancelled and aren't of the given types; a null type counts as kept."""
    return events.where(F.coalesce(F.col("status") != "cancelled", F.lit(True)) & ~F.coalesce(F.col("type").isin(*types_out), F.lit(False)))


def vod_window(vods: DataFrame, rooms: DataFrame) -> DataFrame:
    """Recordings with start = end - duration and the room of their creator, ``unknown`` without one."""
    rows = vods.join(rooms, "creator", "left")
    start = F.col("created_at") - F.make_dt_interval(secs=F.col("duration_ns") / 1_000_000_000)
    return rows.select("uri", "creator", start.alias("starts_at"), F.col("created_at").alias("ends_at"), F.coalesce("room", F.lit("unknown")).alias("room"))


def noise_title_filter(rows: DataFrame, titles: tuple, prefixes: tuple, parts: tuple = ("starting soon",)) -> DataFrame:
    low = F.lower(F.trim("title"))
    noise = low.isin(*titles)
    for p in prefixes:
        noise = noise | low.startswith(p)
    for p in parts:
        noise = noise | low.contains(p)
    return rows.where(~noise)


def talks_for_stream(talks: DataFrame, streams: DataFrame) -> DataFrame:
    """(stream, uri): talks of a stream's room and day, or with its key prefix.

    Equi-joins on (room, day) and on each distinct length of a prefix and the start of the key it stands for.
    """
    out = talks.join(streams.where("room is not null").select("stream", "room", "day"), ["room", "day"]).select("stream", "uri")
    prefixes = streams.where("prefix is not null").select("stream", "prefix", F.length("prefix").alias("_n"))
    lengths = [r["_n"] for r in prefixes.select("_n").distinct().orderBy("_n").collect()]  # as many as lengths differ
    starts = talks.select("uri", F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), F.substring("rkey", 1, n).alias("prefix")) for n in lengths])).alias("_s")).select("uri", "_s.*") if lengths else None
    return (out if starts is None else out.union(starts.join(prefixes, ["_n", "prefix"]).select("stream", "uri"))).distinct()


def tracks_index(talks: DataFrame, streams: DataFrame) -> DataFrame:
    counts = talks_for_stream(talks, streams).groupBy("stream").agg(F.count("*").alias("talks"))
    return streams.select("stream").distinct().join(counts, "stream", "left").select("stream", F.coalesce("talks", F.lit(0)).alias("talks"))


def unmatched_segments(segments: DataFrame, matches: DataFrame, slack_s: float = 5.0, size: float = 600.0) -> DataFrame:
    """Segments that no match's start falls into, with ``slack_s`` at both ends."""
    a = with_buckets(segments.withColumns({"_from": F.col("start_s") - slack_s, "_to": F.col("end_s") + slack_s}), "_from", "_to", size)
    m = matches.select("stream", F.col("match_s").alias("_m"), F.floor(F.col("match_s") / size).alias("_bucket"))
    hit = a.join(m, ["stream", "_bucket"]).where("_m >= _from and _m <= _to").select("stream", "segment").distinct()
    return segments.join(hit, ["stream", "segment"], "left_anti")


def posts_in_talk_window(posts: DataFrame, talks: DataFrame, before_min: int = 5, after_min: int = 30) -> DataFrame:
    """(post, talk): posts naming a talk's handle from 5 minutes before it to 30 after it; one row a pair."""
    rows = posts.join(talks, "handle")
    early = F.col("starts_at") - F.make_dt_interval(mins=F.lit(before_min))
    late = F.col("ends_at") + F.make_dt_interval(mins=F.lit(after_min))
    return rows.where((F.col("created_at") >= early) & (F.col("created_at") <= late)).select("post", "talk").distinct()


def nearest_talk_for_post(posts: DataFrame, talks: DataFrame, before_min: int = 5, after_min: int = 30, bucket_s: int = 3600) -> DataFrame:
    """(post, talk): of talks whose extended window holds the post, the one starting nearest; the smaller talk on ties.

    Talks of one time count once (the smallest), posts of one second are settled once, so a bucket holds at most its
    seconds times its windows, however many talks and posts meet in it.
    """
    t = talks.groupBy("starts_at", "ends_at").agg(F.min("talk").alias("talk"))
    t = t.withColumns({"_a": F.unix_timestamp("starts_at") - 60 * before_min, "_b": F.unix_timestamp("ends_at") + 60 * after_min, "_s": F.unix_timestamp("starts_at")})
    t = t.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket_s), F.floor(F.col("_b") / bucket_s))))
    p = posts.select("post", F.unix_timestamp("created_at").alias("_at"))
    seconds = p.where("_at is not null").select("_at").distinct().withColumn("_bucket", F.floor(F.col("_at") / bucket_s))
    hits = seconds.join(t.select("talk", "_a", "_b", "_s", "_bucket"), "_bucket").where("_at between _a and _b")
    nearest = hits.groupBy("_at").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("_s")).alias("far"), "talk")).alias("_t"))
    return p.join(nearest, "_at").groupBy("post").agg(F.min("_t")["talk"].alias("talk"))


def post_offsets(posts: DataFrame, words: DataFrame) -> DataFrame:
    """(post, talk, offset_ms, byte_position): time since the talk's start, and the byte of the first word ending at or
    after it; past the end, of the last word."""
    rows = posts.withColumn("offset_ms", (F.unix_millis("created_at") - F.unix_millis("starts_at")).cast("long"))
    ahead = as_of(rows.select("post", "talk", "offset_ms"), words.select("talk", "end_ms", "byte_start"), ["talk"], "offset_ms", "end_ms", forward=True)
    last = words.groupBy("talk").agg(F.max_by("byte_start", "end_ms").alias("_last"))
    return ahead.join(last, "talk", "left").select("post", "talk", "offset_ms", F.coalesce("byte_start", "_last").alias("byte_position"))


def assign_speakers(words: DataFrame, diarization: DataFrame, size: float = 60.0) -> DataFrame:
    """(stream, pos, speaker): the segment holding the word's middle (the earliest), else the one with the nearest edge.

    The earliest segment that ends at or after a time has a larger end than all before it, so of the segments in order
    only those that raise the largest end are looked up, as of the time. Words of one middle are settled once.
    """
    mid = words.select("stream", "pos", ((F.col("start_s") + F.col("end_s")) / 2).alias("mid"))
    seg = diarization.select("stream", "event_id", "start_s", "end_s", "speaker")
    points = mid.select("stream", "mid").distinct()
    far = F.max("end_s").over(W.partitionBy("stream").orderBy("start_s", "event_id").rowsBetween(W.unboundedPreceding, -1))
    rising = seg.withColumn("_far", far).where("end_s is not null and (_far is null or end_s > _far)")
    held = as_of(points, rising.select("stream", F.col("end_s").alias("_he"), F.col("start_s").alias("_hs"), F.col("speaker").alias("_in")), ["stream"], "mid", "_he", forward=True)
    held = held.select("stream", "mid", F.when(F.col("_hs") <= F.col("mid"), F.col("_in")).alias("inside"))
    ended = as_of(held, seg.select("stream", F.col("end_s").alias("_e"), F.col("speaker").alias("_es")).distinct(), ["stream"], "mid", "_e")
    both = as_of(ended, seg.select("stream", F.col("start_s").alias("_s"), F.col("speaker").alias("_ss")).distinct(), ["stream"], "mid", "_s", forward=True)
    nearer = F.col("_e").isNotNull() & (F.col("_s").isNull() | (F.col("mid") - F.col("_e") <= F.col("_s") - F.col("mid")))
    found = both.select(F.col("stream").alias("_k"), F.col("mid").alias("_at"), F.coalesce("inside", F.when(nearer, F.col("_es")).otherwise(F.col("_ss"))).alias("speaker"))
    return mid.join(found, F.col("stream").eqNullSafe(F.col("_k")) & F.col("mid").eqNullSafe(F.col("_at")), "left").select("stream", "pos", "speaker")


def match_post_to_talk(posts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(post, talk): from a talk path in a link, else from the first @handle whose speaker has exactly one talk.
    ``speakers``: (handle, talk); a talk listed twice counts once."""
    path = F.nullif(F.regexp_extract("text", r"/talks/([A-Za-z0-9_-]+)", 1), F.lit(""))
    single = speakers.distinct().groupBy(F.lower("handle").alias("handle")).agg(F.count("*").alias("n"), F.first("talk").alias("talk")).where("n = 1").drop("n")
    named = posts.select("post", F.posexplode(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_.-]+)"), 1)).alias("k", "handle")).withColumn("handle", F.lower("handle"))
    by_handle = named.join(single, "handle").groupBy("post").agg(F.min_by("talk", "k").alias("_t"))
    return posts.join(by_handle, "post", "left").select("post", F.coalesce(path, F.col("_t").cast("string")).alias("talk"))


def speaker_talks_by_name(talks: DataFrame, speakers: DataFrame) -> DataFrame:
    """(talk, speaker): comma-split names equal to a speaker's name, whatever the case."""
    names = talks.select("talk", F.explode(F.split("names", ",")).alias("_n")).select("talk", F.lower(F.trim("_n")).alias("_n"))
    return names.join(speakers.select(F.lower("name").alias("_n"), F.col("uri").alias("speaker")), "_n").select("talk", "speaker").distinct()


def talks_on_stream(talks: DataFrame) -> DataFrame:
    """(stream, talk, offset_s): talks by the streams in their JSON sources ([{uri, offset_s}])."""
    parsed = F.from_json("sources", "array<struct<uri: string, offset_s: double>>")
    return talks.select("talk", F.explode(parsed).alias("s")).select(F.col("s.uri").alias("stream"), "talk", F.coalesce("s.offset_s", F.lit(0.0)).alias("offset_s"))


def sources_for_talk(talks: DataFrame) -> DataFrame:
    """(talk, uris): the JSON sources, else the primary one, else none."""
    parsed = F.transform(F.from_json("sources", "array<struct<uri: string>>"), lambda s: s["uri"])
    fallback = F.when(F.col("video_uri").isNotNull(), F.array("video_uri")).otherwise(F.array().cast("array<string>"))
    return talks.select("talk", F.when(F.size(F.coalesce(parsed, F.array().cast("array<string>"))) > 0, parsed).otherwise(fallback).alias("uris"))


def assign_talk_sources(talks: DataFrame, found: DataFrame) -> DataFrame:
    """(talk, sources, primary): a found stream source (talk, uri) replaces or joins the list; individual recordings come first."""
    rows = talks.join(found.select("talk", F.col("uri").alias("_new")), "talk", "left")
    old = F.coalesce("sources", F.array().cast("array<string>"))
    merged = F.when(F.col("_new").isNull(), old).otherwise(F.concat(F.filter(old, lambda s: s != F.col("_new")), F.array("_new")))
    first = F.concat(F.filter(merged, lambda s: ~s.startswith("stream:")), F.filter(merged, lambda s: s.startswith("stream:")))
    return rows.select("talk", first.alias("sources"), F.coalesce("primary", F.try_element_at(first, F.lit(1))).alias("primary"))


def realign_vod(talks: DataFrame, vods: DataFrame, allowed: DataFrame, low: float = 0.5, high: float = 2.0, bucket_s: int = 3600) -> DataFrame:
    """(talk, vod_uri): talks with a duration ratio outside low..high get the longest recording covering their start in
    an allowed room (talk_room, room), else in any room.

    Talks of one room and start are settled once, of recordings of one room, end and length the largest counts, so an
    hour holds at most its distinct times, however many talks and recordings there are.
    """
    odd = talks.where(~F.col("ratio").between(low, high))
    points = odd.select("room", "starts_at").distinct().withColumn("_hour", F.floor(F.unix_timestamp("starts_at") / bucket_s))

    def hours(v: DataFrame) -> DataFrame:
        v = v.withColumns({"v_start": F.col("v_end") - F.make_dt_interval(secs=F.col("duration_s"))})
        return v.withColumn("_hour", F.explode(F.sequence(F.floor(F.unix_timestamp("v_start") / bucket_s), F.floor(F.unix_timestamp("v_end") / bucket_s))))

    v = vods.groupBy(F.col("room").alias("v_room"), F.col("created_at").alias("v_end"), "duration_s").agg(F.max("vod_uri").alias("vod_uri"))
    covers = "v_start <= starts_at and starts_at < v_end"
    longest = F.max(F.struct("duration_s", "vod_uri")).alias("_v")
    rooms = allowed.select(F.col("talk_room").alias("room"), F.col("room").alias("v_room")).distinct()
    first = points.join(rooms, "room").join(hours(v), ["v_room", "_hour"]).where(covers).groupBy("room", "starts_at").agg(longest)
    # recordings of all rooms are met by times, not by talks
    any_room = hours(v.groupBy("v_end", "duration_s").agg(F.max("vod_uri").alias("vod_uri")))
    rest = points.select("starts_at", "_hour").distinct().join(any_room, "_hour").where(covers).groupBy("starts_at").agg(longest)
    own = F.struct(F.lit(1).alias("own"), "_v.duration_s", "_v.vod_uri")
    got = odd.select("talk", "room", "starts_at").join(first.select("room", "starts_at", own.alias("_a")), ["room", "starts_at"], "left")
    got = got.join(rest.select("starts_at", own.withField("own", F.lit(0)).alias("_b")), "starts_at", "left")
    best = got.groupBy("talk").agg(F.max(F.coalesce("_a", "_b")).alias("_v"))
    return odd.select("talk").join(best, "talk", "left").select("talk", F.col("_v.vod_uri").alias("vod_uri"))


def reconcile_end_times(matches: DataFrame, segments: DataFrame, near_s: float = 60.0) -> DataFrame:
    """(stream, match_s, end_s): the next match's start if it is at most ``near_s`` later, else the end of the segment
    that began last by match_s + 1; the next start or the segment's end is missing for the last or none."""
    ordered = W.partitionBy("stream").orderBy("match_s")
    rows = matches.select("stream", "match_s", F.lead("match_s").over(ordered).alias("_next"), (F.col("match_s") + 1).alias("_at"))
    found = as_of(rows, segments.select("stream", F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), ["stream"], "_at", "_s")
    return found.select("stream", "match_s", F.when(F.col("_next") - F.col("match_s") <= near_s, F.col("_next")).otherwise(F.coalesce("_e", "_next")).alias("end_s"))


def sustained_new_speaker(diarization: DataFrame, span_s: float = 120.0, least_s: float = 30.0) -> DataFrame:
    """(stream, event_id, at_s, speaker): segments whose speaker talks ``least_s`` or more in the next ``span_s`` and not
    at all in the ``span_s`` before. Range frames on one sort; no join."""
    ms = F.round(F.col("start_s") * 1000).cast("long")
    one = W.partitionBy("stream", "speaker").orderBy(ms)
    length = F.col("end_s") - F.col("start_s")
    ahead, back = F.sum(length).over(one.rangeBetween(0, int(span_s * 1000))), F.max("end_s").over(one.rowsBetween(W.unboundedPreceding, -1))
    rows = diarization.withColumns({"_ahead": ahead, "_back": back})
    fresh = (F.col("_ahead") >= least_s) & (F.col("_back").isNull() | (F.col("_back") < F.col("start_s") - span_s))
    return rows.where(fresh).select("stream", "event_id", F.col("start_s").alias("at_s"), "speaker")


def token_set_similarity(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def set_change(before: Column, after: Column) -> Column:
    """2: no common speaker; 1: fewer than half of the smaller set in common; else 0. An empty side is no change."""
    common, least = F.size(F.array_intersect(before, after)), F.least(F.size(before), F.size(after))
    return F.when(least == 0, 0).when(common == 0, 2).when(common * 2 < least, 1).otherwise(0)
