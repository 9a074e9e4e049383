"""Queries on alignment in time and by name, and on records."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import align as L
from spanloom.operators import index, reads
from spanloom.operators import sequence as S

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query
from .timed import CLEAN, SEGMENTS, TERMS, blocks_sql


@query("SELECT event_id FROM events WHERE value <= 300 AND event_type NOT IN ('view', 'click')")
def schedule_filter(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("value") > 300, "cancelled").alias("status"), F.col("event_type").alias("type"))
    return L.schedule_filter(rows, ("view", "click")).select("event_id")


@query("SELECT o_orderkey AS uri, o_custkey % 7 AS creator, o_orderdate - to_seconds(o_orderkey % 5000) AS starts_at, o_orderdate AS ends_at, CASE WHEN o_custkey % 7 < 5 THEN 'room ' || (o_custkey % 7) ELSE 'unknown' END AS room FROM orders")
def vod_window(spark, d):
    vods = table(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), (F.col("o_custkey") % 7).alias("creator"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 5000 * 1_000_000_000).alias("duration_ns"))
    rooms = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("creator")).distinct().where("creator < 5").select("creator", F.concat(F.lit("room "), F.col("creator")).alias("room"))
    return L.vod_window(vods, rooms)


@query("SELECT p_partkey AS uri, p_name AS title FROM part WHERE NOT (lower(trim(p_name)) IN ('red ring', 'small widget') OR starts_with(lower(p_name), 'blue') OR contains(lower(p_name), 'nut'))")
def noise_title_filter(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("title"))
    return L.noise_title_filter(rows, ("red ring", "small widget"), ("blue",), ("nut",))


STREAMS = ", st AS (SELECT DISTINCT 's' || o_orderpriority || year(o_orderdate) AS stream, o_orderpriority AS room, make_date(year(o_orderdate), 3, 1) AS day, CASE WHEN o_orderpriority = '5-LOW' THEN (year(o_orderdate) - 1900)::VARCHAR END AS prefix FROM orders), hit AS (SELECT stream, uri FROM st JOIN talks ON st.room = talks.room AND starts_at::DATE = day UNION SELECT stream, uri FROM st JOIN talks ON starts_with(uri::VARCHAR, prefix))"


def streams(spark, d):
    o, year = table(spark, d, "orders"), F.year("o_orderdate")
    return o.select(F.concat(F.lit("s"), "o_orderpriority", year).alias("stream"), F.col("o_orderpriority").alias("room"), F.make_date(year, F.lit(3), F.lit(1)).alias("day"), F.when(F.col("o_orderpriority") == "5-LOW", (year - 1900).cast("string")).alias("prefix")).distinct()


def dated_talks(spark, d):
    return A.talks(spark, d).withColumns({"day": F.to_date("starts_at"), "rkey": F.col("uri").cast("string")})


@query(V(f"{STREAMS} SELECT * FROM hit", "talks"))
def talks_for_stream(spark, d):
    return L.talks_for_stream(dated_talks(spark, d), streams(spark, d))


@query(V(f"{STREAMS} SELECT stream, count(uri)::BIGINT AS talks FROM st LEFT JOIN hit USING (stream) GROUP BY 1", "talks"))
def tracks_index(spark, d):
    return L.tracks_index(dated_talks(spark, d), streams(spark, d))


MATCHES = ", matches AS (SELECT stream, start_s + 2 AS match_s FROM diarization WHERE event_id % 9 = 0)"


@query(V(blocks_sql("diarization", 5.0) + SEGMENTS + MATCHES + " SELECT stream, segment FROM ends s WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.stream = s.stream AND match_s BETWEEN start_s - 5 AND end_s + 5)", "diarization"))
def unmatched_segments(spark, d):
    di = A.diarization(spark, d)
    segments = S.talk_segments(S.speech_blocks(di))
    return L.unmatched_segments(segments, di.where("event_id % 9 = 0").select("stream", (F.col("start_s") + 2).alias("match_s"))).select("stream", "segment")


@query(V(blocks_sql("diarization", 5.0) + SEGMENTS + MATCHES + ", nx AS (SELECT stream, match_s, lead(match_s) OVER (PARTITION BY stream ORDER BY match_s) AS n FROM matches) SELECT nx.stream, match_s, CASE WHEN n - match_s <= 60 THEN n ELSE coalesce(arg_max(e.end_s, e.start_s), n) END AS end_s FROM nx LEFT JOIN ends e ON e.stream = nx.stream AND e.start_s <= match_s + 1 GROUP BY nx.stream, match_s, n", "diarization"))
def reconcile_end_times(spark, d):
    di = A.diarization(spark, d)
    return L.reconcile_end_times(di.where("event_id % 9 = 0").select("stream", (F.col("start_s") + 2).alias("match_s")), S.talk_segments(S.speech_blocks(di)))


@query(V("SELECT stream, event_id, start_s AS at_s, speaker FROM (SELECT *, sum(end_s - start_s) OVER (PARTITION BY stream, speaker ORDER BY round(start_s * 1000)::BIGINT RANGE BETWEEN CURRENT ROW AND 120000 FOLLOWING) AS ahead, max(end_s) OVER (PARTITION BY stream, speaker ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM diarization) WHERE ahead >= 30 AND (back IS NULL OR back < start_s - 120)", "diarization"))
def sustained_new_speaker(spark, d):
    return L.sustained_new_speaker(A.diarization(spark, d))


@query(V("SELECT DISTINCT c.uri AS post, t.uri AS talk FROM comments c JOIN talks t ON c.author = t.uri % 150 AND c.created_at - INTERVAL 9862 DAY BETWEEN t.starts_at - INTERVAL 5 MINUTE AND t.starts_at + INTERVAL 75 MINUTE", "comments", "talks"))
def posts_in_talk_window(spark, d):
    """Posts and talks by a made-up handle; posts are moved to the talks' years."""
    posts = A.comments(spark, d).select(F.col("uri").alias("post"), F.col("author").alias("handle"), (F.col("created_at") - F.make_dt_interval(days=F.lit(9862))).alias("created_at"))
    talks = A.talks(spark, d).select(F.col("uri").alias("talk"), (F.col("uri") % 150).alias("handle"), F.col("starts_at").cast("timestamp").alias("starts_at"))
    return L.posts_in_talk_window(posts, talks.withColumn("ends_at", F.col("starts_at") + F.make_dt_interval(mins=F.lit(45))))


@query(V(", p AS (SELECT uri AS post, epoch(date_trunc('second', created_at))::BIGINT - 9862 * 86400 AS t FROM comments), s AS (SELECT uri AS talk, epoch(starts_at)::BIGINT AS s FROM schedule) SELECT post, arg_min(talk, (abs(t - s), talk)) AS talk FROM p JOIN s ON t BETWEEN s - 300 AND s + 45 * 60 + 1800 GROUP BY 1", "comments", "schedule"))
def nearest_talk_for_post(spark, d):
    posts = A.comments(spark, d).select(F.col("uri").alias("post"), (F.col("created_at") - F.make_dt_interval(days=F.lit(9862))).alias("created_at"))
    return L.nearest_talk_for_post(posts, A.schedule(spark, d).select(F.col("uri").alias("talk"), "starts_at", "ends_at"))


@query(V(", p AS (SELECT uri AS post, subject_uri AS talk, (uri % 90) * 1000 AS offset_ms FROM comments WHERE subject_uri IN (SELECT doc_id FROM words)) SELECT post, talk, offset_ms, coalesce((SELECT arg_min(byte_start, (end_ms, pos)) FROM words w WHERE w.doc_id = talk AND w.end_ms >= offset_ms), (SELECT arg_max(byte_start, end_ms) FROM words w WHERE w.doc_id = talk)) AS byte_position FROM p", "comments", "words"))
def post_offsets(spark, d):
    w = A.words(spark, d).withColumnRenamed("doc_id", "talk")
    zero = F.timestamp_seconds(F.lit(1_700_000_000))
    posts = A.comments(spark, d).select(F.col("uri").alias("post"), F.col("subject_uri").alias("talk"), zero.alias("starts_at"), (zero + F.make_dt_interval(secs=(F.col("uri") % 90))).alias("created_at"))
    return L.post_offsets(posts.join(w.select("talk").distinct(), "talk", "left_semi"), w)


@query(V("""
, m AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS stream, doc_id * 100000 + pos AS pos, (pos * 7 + doc_id % 7 + 0.6)::DOUBLE AS mid FROM words),
i AS (SELECT m.stream, m.pos, arg_min(speaker, (start_s, event_id)) AS speaker FROM m JOIN diarization g ON g.stream = m.stream AND mid BETWEEN start_s AND end_s GROUP BY ALL),
e AS (SELECT m.stream, m.pos, mid, max(end_s) AS e, arg_max(speaker, end_s) AS es FROM m LEFT JOIN diarization g ON g.stream = m.stream AND end_s <= mid GROUP BY ALL),
s AS (SELECT m.stream, m.pos, min(start_s) AS s, arg_min(speaker, start_s) AS ss FROM m LEFT JOIN diarization g ON g.stream = m.stream AND start_s >= mid GROUP BY ALL)
SELECT e.stream, e.pos, coalesce(i.speaker, CASE WHEN e IS NOT NULL AND (s IS NULL OR mid - e <= s - mid) THEN es ELSE ss END) AS speaker FROM e JOIN s USING (stream, pos) LEFT JOIN i USING (stream, pos)""", "words", "diarization"))
def assign_speakers(spark, d):
    """The words of all documents, laid out over the streams."""
    return L.assign_speakers(A.streamed_words(spark, d, 7.0, 1.2), A.diarization(spark, d))


@query("WITH p AS (SELECT doc_id AS post, CASE WHEN doc_id % 3 = 0 THEN 'see https://x.org/talks/t' || doc_id || '?a=1 @u1' WHEN doc_id % 3 = 1 THEN 'hi @u' || (doc_id % 40) || ' and @u' || (doc_id % 7) ELSE 'none' END AS text FROM documents), sp AS (SELECT 'u' || (s_suppkey % 30) AS handle, s_suppkey % 45 AS talk FROM supplier), one AS (SELECT handle, any_value(talk) AS talk FROM (SELECT DISTINCT handle, talk FROM sp) GROUP BY 1 HAVING count(*) = 1), h AS (SELECT post, unnest(regexp_extract_all(text, '@([A-Za-z0-9_.-]+)', 1)) AS handle, unnest(range(0, len(regexp_extract_all(text, '@([A-Za-z0-9_.-]+)', 1)))) AS k FROM p), b AS (SELECT post, arg_min(talk, k) AS t FROM h JOIN one USING (handle) GROUP BY 1) SELECT post, coalesce(nullif(regexp_extract(text, '/talks/([A-Za-z0-9_-]+)', 1), ''), t::VARCHAR) AS talk FROM p LEFT JOIN b USING (post)")
def match_post_to_talk(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("see https://x.org/talks/t"), i, F.lit("?a=1 @u1"))).when(i % 3 == 1, F.concat(F.lit("hi @u"), i % 40, F.lit(" and @u"), i % 7)).otherwise("none")
    speakers = table(spark, d, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey") % 30).alias("handle"), (F.col("s_suppkey") % 45).alias("talk"))
    return L.match_post_to_talk(table(spark, d, "documents").select(i.alias("post"), text.alias("text")), speakers)


@query(V(", n AS (SELECT talk_uri AS talk, string_agg(upper(name), ' , ') AS names FROM talk_speakers JOIN speakers ON speaker_uri = uri GROUP BY 1) SELECT talk_uri AS talk, speaker_uri AS speaker FROM talk_speakers", "talk_speakers", "speakers"))
def speaker_talks_by_name(spark, d):
    sp = A.speakers(spark, d)
    named = A.talk_speakers(spark, d).join(sp, F.col("speaker_uri") == F.col("uri")).groupBy(F.col("talk_uri").alias("talk")).agg(F.array_join(F.collect_list(F.upper("name")), " , ").alias("names"))
    return L.speaker_talks_by_name(named, sp)


def sourced(spark, d):
    k = F.col("o_orderkey")
    js = F.when(k % 4 == 0, F.concat(F.lit('[{"uri":"s'), k % 6, F.lit('","offset_s":'), k % 100, F.lit('},{"uri":"v'), k, F.lit('"}]'))).when(k % 4 == 1, "[]")
    return table(spark, d, "orders").select(k.alias("talk"), js.alias("sources"), F.when(k % 3 > 0, F.concat(F.lit("p"), k)).alias("video_uri"))


@query("SELECT 's' || (o_orderkey % 6) AS stream, o_orderkey AS talk, (o_orderkey % 100)::DOUBLE AS offset_s FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'v' || o_orderkey, o_orderkey, 0.0::DOUBLE FROM orders WHERE o_orderkey % 4 = 0")
def talks_on_stream(spark, d):
    return L.talks_on_stream(sourced(spark, d))


@query("SELECT o_orderkey AS talk, CASE WHEN o_orderkey % 4 = 0 THEN ['s' || (o_orderkey % 6), 'v' || o_orderkey] WHEN o_orderkey % 3 > 0 THEN ['p' || o_orderkey] ELSE [] END AS uris FROM orders")
def sources_for_talk(spark, d):
    return L.sources_for_talk(sourced(spark, d))


@query("SELECT o_orderkey AS talk, CASE WHEN o_orderkey % 2 = 0 THEN ['v' || o_orderkey, 'stream:a', 'stream:b'] ELSE ['v' || o_orderkey, 'stream:a'] END AS sources, 'v' || o_orderkey AS \"primary\" FROM orders")
def assign_talk_sources(spark, d):
    k = F.col("o_orderkey")
    talks = table(spark, d, "orders").select(k.alias("talk"), F.array(F.lit("stream:a"), F.concat(F.lit("v"), k)).alias("sources"), F.lit(None).cast("string").alias("primary"))
    return L.assign_talk_sources(talks, talks.where("talk % 2 = 0").select("talk", F.lit("stream:b").alias("uri")))


@query(V(", t AS (SELECT uri AS talk, room, starts_at, uri % 40 / 10 AS ratio FROM schedule), v AS (SELECT vod_uri, room AS v_room, created_at - to_seconds(duration_s) AS s, created_at AS e, duration_s FROM vods), odd AS (SELECT * FROM t WHERE NOT ratio BETWEEN 0.5 AND 2), h AS (SELECT talk, vod_uri FROM odd JOIN v ON s <= starts_at AND starts_at < e QUALIFY row_number() OVER (PARTITION BY talk ORDER BY (v_room = (room + 1) % 5)::INT DESC, duration_s DESC, vod_uri DESC) = 1) SELECT talk, vod_uri FROM odd LEFT JOIN h USING (talk)", "schedule", "vods"))
def realign_vod(spark, d):
    talks = A.schedule(spark, d).select(F.col("uri").alias("talk"), "room", "starts_at", (F.col("uri") % 40 / 10).alias("ratio"))
    allowed = talks.select(F.col("room").alias("talk_room"), ((F.col("room") + 1) % 5).alias("room")).distinct()
    return L.realign_vod(talks, A.vods(spark, d), allowed)


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def token_set_similarity(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.array_distinct(F.split("p_name", " ")).alias("wa"))
    q = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("wa").alias("wb"))
    return p.join(q, "a").select("a", "b", F.round(L.token_set_similarity(F.col("wa"), F.col("wb")), 6).alias("similarity"))


@query(V(", b AS (SELECT event_id, list(speaker) OVER (PARTITION BY stream ORDER BY start_s, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p, list(speaker) OVER (PARTITION BY stream ORDER BY start_s, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS q FROM diarization), s AS (SELECT event_id, len(list_distinct(list_intersect(p, q))) AS c, least(coalesce(len(list_distinct(p)), 0), len(list_distinct(q))) AS l FROM b) SELECT event_id, (CASE WHEN l = 0 THEN 0 WHEN c = 0 THEN 2 WHEN c * 2 < l THEN 1 ELSE 0 END)::INTEGER AS change FROM s", "diarization"))
def set_change(spark, d):
    from pyspark.sql import Window as W

    o = W.partitionBy("stream").orderBy(*S.SPEECH)
    rows = A.diarization(spark, d).select("event_id", F.collect_set("speaker").over(o.rowsBetween(-3, -1)).alias("p"), F.collect_set("speaker").over(o.rowsBetween(0, 2)).alias("q"))
    return rows.select("event_id", L.set_change(F.col("p"), F.col("q")).alias("change"))


@query(V(f"{TERMS}, d AS (SELECT lemma, doc_id, count(*)::BIGINT AS c, min(start_ms) AS f FROM terms GROUP BY ALL) SELECT lemma AS term, list(doc_id || ':' || c || ':' || f ORDER BY c DESC, doc_id) AS docs FROM d GROUP BY 1 HAVING count(*) >= 2", "words"))
def term_entries(spark, d):
    rows = index.term_entries(A.words(spark, d))
    return rows.select("term", F.transform("docs", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["count"].cast("string"), x["first_ms"].cast("string"))).alias("docs"))


@query("SELECT o_orderkey AS uri, to_json(struct_pack(title := 'Talk ' || o_orderkey, room := o_orderpriority))::VARCHAR AS record FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, to_json(struct_pack(title := 'Talk ' || o_orderkey))::VARCHAR FROM orders WHERE o_orderkey % 2 = 1")
def build_publish_records(spark, d):
    """Records as JSON without null fields."""
    t = A.talks(spark, d).select("uri", "title", F.when(F.col("uri") % 2 == 0, F.col("room")).alias("room"))
    return t.select("uri", F.to_json(F.struct("title", "room")).alias("record"))


@query("SELECT l_orderkey AS talk, l_suppkey AS speaker FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL UNION ALL SELECT o_orderkey, o_custkey % 9 FROM orders WHERE o_orderkey % 2 = 0")
def explode_talk_speakers(spark, d):
    """Links of talks with a list are replaced by the list, without repeats; the others' stay."""
    from spanloom.sources.records import replace_links

    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("talk"), F.col("l_suppkey").alias("speaker")).distinct()
    k = F.col("o_custkey") % 9
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("talk"), F.when(F.col("o_orderkey") % 2 == 0, F.array(k, k)).alias("speakers"))
    return replace_links(old, records, "talk", "speakers", "speaker")


@query("SELECT doc_id, lang, source FROM documents")
def prune_wide_columns(spark, d):
    """The list view: no text or counts, which Parquet then skips."""
    return table(spark, d, "documents").drop("text", "n_chars")


@query(V(", t AS (SELECT doc_id, (pos // 500)::INTEGER AS chunk, count(*)::BIGINT AS n, min(start_ms) AS first_ms FROM words GROUP BY ALL) SELECT doc_id, list(chunk || ':' || n ORDER BY chunk) AS chunks FROM t GROUP BY 1", "words"))
def drop_nested_field(spark, d):
    """A field dropped inside an array of structs."""
    rows = S.token_chunks(A.words(spark, d), 500).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "n", "start_ms"))).alias("c"))
    thin = rows.select("doc_id", F.transform("c", lambda x: x.dropFields("start_ms")).alias("c"))
    return thin.select("doc_id", F.transform("c", lambda x: F.concat_ws(":", x["chunk"].cast("string"), x["n"].cast("string"))).alias("chunks"))


@query("SELECT p_brand AS cluster, list(p_partkey ORDER BY p_partkey) AS members FROM part WHERE contains(p_name, 'ring') GROUP BY 1")
def filter_clusters(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("c"))
    kept = rows.select("cluster", F.filter("c", lambda x: F.contains(x["p_name"], F.lit("ring"))).alias("c")).where(F.size("c") > 0)
    return kept.select("cluster", F.transform("c", lambda x: x["p_partkey"]).alias("members"))


@query(V("SELECT uri FROM mentions WHERE author NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", "mentions"))
def blocked_authors_filter(spark, d):
    blocked = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("author"))
    return A.mentions(spark, d).join(blocked, "author", "left_anti").select("uri")


@query(V("SELECT uri, coalesce(CASE WHEN uri % 3 = 0 THEN talk_uri END, t.rkey) AS talk FROM mentions LEFT JOIN (SELECT o_orderkey AS rkey FROM orders WHERE o_orderkey % 2 = 0) t ON t.rkey = talk_uri", "mentions"))
def backfill_talk_key(spark, d):
    rows = A.mentions(spark, d).select("uri", "talk_uri", F.when(F.col("uri") % 3 == 0, F.col("talk_uri")).alias("talk"))
    keys = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("talk_uri"), F.col("o_orderkey").alias("_k"))
    return rows.join(keys, "talk_uri", "left").select("uri", F.coalesce("talk", "_k").alias("talk"))


@query("SELECT s_suppkey AS project, coalesce('Talk ' || o_orderkey, s_name) AS title FROM supplier LEFT JOIN orders ON o_orderkey = s_suppkey * 500")
def attach_project_titles(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), "s_name", (F.col("s_suppkey") * 500).alias("uri"))
    return p.join(A.talks(spark, d).select("uri", "title"), "uri", "left").select("project", F.coalesce("title", "s_name").alias("title"))


@query("SELECT stream AS talk, event_id, value FROM (SELECT event_type || user_id AS stream, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def best_match_per_talk(spark, d):
    rows = table(spark, d, "events").select(F.concat("event_type", "user_id").alias("talk"), "event_id", "value")
    return S.best_match_per_talk(rows, "talk", "value", "event_id")


@query(V("SELECT uri, (row_number() OVER (PARTITION BY talk_uri ORDER BY CASE mention_type WHEN 'during_talk' THEN 0 ELSE 1 END, offset_ms, uri))::INTEGER AS place FROM mentions", "mentions"))
def case_order(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("talk_uri").orderBy(F.when(F.col("mention_type") == "during_talk", 0).otherwise(1), "offset_ms", "uri")
    return A.mentions(spark, d).select("uri", F.row_number().over(order).alias("place"))


@query(V("SELECT uri, CASE WHEN mention_type = 'during_talk' AND offset_ms >= 5000 THEN 'during' ELSE 'rest' END AS part FROM mentions", "mentions"))
def split_mentions(spark, d):
    part = F.when((F.col("mention_type") == "during_talk") & (F.col("offset_ms") >= 5000), "during").otherwise("rest")
    return A.mentions(spark, d).select("uri", part.alias("part")).orderBy("part", "uri")


@query(V("SELECT doc_id, min(start_ms) AS start_ms, flatten(list(CASE WHEN gap_ms > 0 THEN [-gap_ms, dur_ms] ELSE [dur_ms] END ORDER BY pos)) AS timings FROM words GROUP BY 1", "words"))
def compact_transcripts(spark, d):
    from spanloom.functions.timing import encode_signed

    return encode_signed(A.words(spark, d))


@query(V("SELECT doc_id // 4 AS stream, doc_id % 4 AS chunk, pos, word, start_ms + doc_id % 4 * 1200000 AS start_ms FROM words", "words"))
def stitch_chunks(spark, d):
    """Words of chunks moved to the stream's clock, 20 minutes a chunk."""
    w = A.words(spark, d)
    return w.select(F.floor(F.col("doc_id") / 4).alias("stream"), (F.col("doc_id") % 4).alias("chunk"), "pos", "word", (F.col("start_ms") + F.col("doc_id") % 4 * 1_200_000).alias("start_ms"))


@query(V("SELECT doc_id, start_s, tolerance_s FROM ground_truth WHERE verified", "ground_truth"))
def export_ground_truth(spark, d):
    return A.ground_truth(spark, d).where("verified").select("doc_id", "start_s", "tolerance_s")


@query("SELECT event_id, (ts - INTERVAL 7 HOUR)::DATE AS day, (row_number() OVER (PARTITION BY (ts - INTERVAL 7 HOUR)::DATE, hour(ts - INTERVAL 7 HOUR) ORDER BY ts, event_id))::INTEGER AS place, hour(ts - INTERVAL 7 HOUR)::INTEGER AS slot FROM events")
def day_slots(spark, d):
    from pyspark.sql import Window as W

    local = F.col("ts").cast("timestamp") - F.make_dt_interval(hours=F.lit(7))
    rows = table(spark, d, "events").select("event_id", "ts", reads.local_day(F.col("ts").cast("timestamp")).alias("day"), F.hour(local).alias("slot"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("day", "slot").orderBy("ts", "event_id"))).drop("ts")


@query("SELECT p_partkey AS uri, list_filter(string_split(lower(p_name || ' with ' || p_type), ' '), lambda w: length(w) >= 4 AND w NOT IN ('with', 'from', 'that', 'this', 'your', 'what', 'when', 'where', 'have', 'will', 'about', 'into', 'over', 'talk')) AS words FROM part")
def title_keywords(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), T.title_keywords(F.concat("p_name", F.lit(" with "), "p_type")).alias("words"))


@query(V(", b AS (SELECT doc_id, start_ms // 10000 AS bucket, pos, byte_start, byte_end, min(byte_start) OVER (PARTITION BY doc_id, start_ms // 10000) AS base FROM words) SELECT doc_id, bucket, pos, byte_start - base AS rel_start, byte_end - base AS rel_end FROM b", "words"))
def rebase_chunk(spark, d):
    """Spans in time buckets with bytes counted from the bucket's text."""
    from pyspark.sql import Window as W

    w = A.words(spark, d).withColumn("bucket", F.floor(F.col("start_ms") / 10_000))
    base = F.min("byte_start").over(W.partitionBy("doc_id", "bucket"))
    return w.select("doc_id", "bucket", "pos", (F.col("byte_start") - base).alias("rel_start"), (F.col("byte_end") - base).alias("rel_end"))


@query(V(f", c AS (SELECT doc_id, pos, word, {CLEAN} AS term FROM words) SELECT DISTINCT term FROM c WHERE term <> ''", "words"))
def clean_tokens(spark, d):
    return A.words(spark, d).select(T.clean_token(F.col("word")).alias("term")).where("term <> ''").distinct()


@query("SELECT 'did:' || user_id AS did, 'k' || event_id AS rkey, 'at://did:' || user_id || '/c.e/k' || event_id AS uri, CASE event_type WHEN 'error' THEN 'delete' ELSE 'update' END AS operation, event_id AS time_us FROM events WHERE event_id % 10 <> 3")
def parse_commit_events(spark, d):
    """Commit lines made from events; each tenth lacks a time and is dropped."""
    from spanloom.sources.records import parse_commit_events as parse

    i = F.col("event_id")
    commit = F.struct(F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"), F.lit("c.e").alias("collection"), F.concat(F.lit("k"), i).alias("rkey"), F.lit("r").alias("rev"))
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.concat(F.lit("did:"), "user_id").alias("did"), F.lit("commit").alias("kind"), F.when(i % 10 != 3, i).alias("time_us"), commit.alias("commit"))).alias("value"))
    return parse(lines).select("did", "rkey", "uri", "operation", "time_us")


@query(V("SELECT uri, time_us, record FROM commits WHERE operation = 'update' AND (uri % 4 <> 0 OR rev % 2 = 0)", "commits"))
def route_commits(spark, d):
    from spanloom.sources.records import route_commits as route

    c = A.commits(spark, d).withColumns({"collection": F.concat(F.lit("c."), "operation", F.when(F.col("uri") % 4 == 0, ".layer").otherwise("")), "did": F.concat(F.lit("did:"), F.col("rev") % 2)})
    return route(c, ["c.update", "c.update.layer"], ["c.update.layer"], "did:0").select("uri", "time_us", "record")


@query(V("SELECT doc_id, list(text ORDER BY k) AS marked FROM (SELECT doc_id, start_ms // 15000 AS k, '[' || (min(start_ms) // 1000) || 's] ' || string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY ALL) GROUP BY 1", "words"))
def time_marked_text(spark, d):
    """Text in stretches of 15 s, each led by the time of its first word."""
    w = A.words(spark, d).withColumn("k", F.floor(F.col("start_ms") / 15_000))
    one = F.sort_array(F.collect_list(F.struct("pos", "word")))
    rows = w.groupBy("doc_id", "k").agg(F.min("start_ms").alias("a"), one.alias("ws"))
    text = F.concat(F.lit("["), F.floor(F.col("a") / 1000), F.lit("s] "), F.array_join(F.transform("ws", lambda x: x["word"]), " "))
    out = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", text.alias("t")))).alias("m"))
    return out.select("doc_id", F.transform("m", lambda x: x["t"]).alias("marked"))
