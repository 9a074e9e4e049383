"""Queries on talks, people, comments, posts and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import entities as E
from spanloom.operators import reads as R
from spanloom.operators import sequence as S

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query

NAMES = ", names AS (SELECT talk_uri, list(name ORDER BY name) AS speakers FROM talk_speakers JOIN speakers ON speaker_uri = speakers.uri GROUP BY talk_uri)"


@query(V(f"{NAMES} SELECT uri, title, starts_at, room, category, duration_s, coalesce(speakers, []) AS speakers FROM talks LEFT JOIN names ON uri = talk_uri", "talks", "speakers", "talk_speakers"))
def talks_with_speakers(spark, d):
    return R.talks_with_speakers(A.talks(spark, d), A.talk_speakers(spark, d), A.speakers(spark, d))


@query(V(f"{NAMES}, cs AS (SELECT talk_uri, list(DISTINCT name ORDER BY name) AS concepts FROM talk_concepts JOIN concepts ON concept_uri = concepts.uri GROUP BY talk_uri) SELECT uri, title, starts_at, room, category, duration_s, coalesce(speakers, []) AS speakers, coalesce(concepts, []) AS concepts FROM talks LEFT JOIN names ON uri = names.talk_uri LEFT JOIN cs ON uri = cs.talk_uri", "talks", "speakers", "talk_speakers", "concepts", "talk_concepts"))
def talk_detail(spark, d):
    return R.talk_detail(A.talks(spark, d), A.talk_speakers(spark, d), A.speakers(spark, d), A.talk_concepts(spark, d), A.concepts(spark, d))


@query(V("SELECT speaker_uri, (row_number() OVER (PARTITION BY speaker_uri ORDER BY starts_at NULLS FIRST, talk_uri))::INTEGER AS place, talk_uri AS uri, title FROM talk_speakers JOIN talks ON talk_uri = uri", "talks", "talk_speakers"))
def speaker_detail(spark, d):
    return R.entity_talks(A.talk_speakers(spark, d), A.talks(spark, d), "speaker_uri")


MERGES = ", merges AS (SELECT p_partkey AS concept_uri, p_partkey - p_partkey % 3 AS canonical FROM part)"


def merges(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("concept_uri"), (key - key % 3).alias("canonical"))


@query(V(f"{MERGES}, l AS (SELECT DISTINCT canonical, talk_uri FROM talk_concepts JOIN merges USING (concept_uri)) SELECT canonical, (row_number() OVER (PARTITION BY canonical ORDER BY starts_at NULLS FIRST, talk_uri))::INTEGER AS place, talk_uri AS uri, title FROM l JOIN talks ON talk_uri = uri", "talks", "talk_concepts"))
def concept_detail(spark, d):
    links = A.talk_concepts(spark, d).join(merges(spark, d), "concept_uri")
    return R.entity_talks(links, A.talks(spark, d), "canonical")


@query(V("SELECT uri, name FROM speakers", "speakers"))
def list_speakers(spark, d):
    return A.speakers(spark, d).orderBy("name", "uri")


@query(V("SELECT uri, name FROM concepts", "concepts"))
def list_concepts(spark, d):
    return A.concepts(spark, d).select("uri", "name").orderBy("name", "uri")


@query(V(", tr AS (SELECT uri + 1000 AS uri, uri AS talk_uri FROM talks WHERE uri < 500), one AS (SELECT c.uri, coalesce(tr.talk_uri, c.subject_uri) AS talk_uri FROM comments c LEFT JOIN tr ON c.subject_uri = tr.uri) SELECT * FROM one WHERE talk_uri IN (SELECT uri FROM talks)", "comments", "talks"))
def comments_by_talk(spark, d):
    talks = A.talks(spark, d)
    tr = talks.where("uri < 500").select((F.col("uri") + 1000).alias("uri"), F.col("uri").alias("talk_uri"))
    return R.comments_by_talk(A.comments(spark, d), talks, tr).select("uri", "talk_uri")


@query(V("SELECT c.uri, author, text, handle FROM comments c LEFT JOIN profiles ON author = did", "comments", "profiles"))
def comments_with_authors(spark, d):
    return R.with_authors(A.comments(spark, d).select("uri", "author", "text"), A.profiles(spark, d))


@query(V(", n AS (SELECT m.*, handle FROM mentions m LEFT JOIN profiles ON author = did), t AS (SELECT parent_uri, list(uri ORDER BY offset_ms, uri) AS replies FROM n WHERE parent_uri IS NOT NULL GROUP BY 1) SELECT talk_uri, (row_number() OVER (PARTITION BY talk_uri ORDER BY CASE mention_type WHEN 'during_talk' THEN 0 ELSE 1 END, offset_ms, uri))::INTEGER AS place, uri, handle, coalesce(replies, []) AS replies FROM n LEFT JOIN t ON t.parent_uri = n.uri WHERE n.parent_uri IS NULL", "mentions", "profiles"))
def mentions_with_threads(spark, d):
    return R.mentions_with_threads(A.mentions(spark, d), A.profiles(spark, d))


@query(V("SELECT m.uri, t.talk_title FROM mentions m LEFT JOIN (SELECT uri // 2 AS rkey, arg_min(title, uri) AS talk_title FROM talks GROUP BY 1) t ON t.rkey = m.talk_uri", "mentions", "talks"))
def attach_talk_title(spark, d):
    talks = A.talks(spark, d).withColumn("rkey", F.floor(F.col("uri") / 2))
    return R.attach_one_title(A.mentions(spark, d), talks, "talk_uri").select("uri", "talk_title")


@query(V("SELECT DISTINCT author AS did FROM comments WHERE author NOT IN (SELECT did FROM profiles)", "comments", "profiles"))
def missing_profiles(spark, d):
    return R.missing_profiles(A.comments(spark, d), A.profiles(spark, d))


@query("SELECT event_id, ts AS fetched_at FROM events WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR")
def stale_profiles(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("fetched_at"))
    return R.stale_profiles(rows, "fetched_at", F.lit("2024-01-30").cast("timestamp"))


@query(V(", e AS (SELECT subject_uri, text AS emoji, count(*) AS n FROM comments WHERE text IN ('👍', '❤') GROUP BY ALL), b AS (SELECT subject_uri, list(emoji || ':' || n ORDER BY n DESC, emoji)[1:3] AS reactions FROM e GROUP BY 1), o AS (SELECT subject_uri, count(*) AS c FROM comments WHERE text NOT IN ('👍', '❤') GROUP BY 1) SELECT subject_uri, reactions, coalesce(c, 0)::BIGINT AS comments FROM b FULL JOIN o USING (subject_uri)", "comments"))
def reaction_summary(spark, d):
    return R.reaction_summary(A.comments(spark, d))


@query(V("SELECT subject_uri, text, count(*)::BIGINT AS n FROM comments WHERE byte_start IS NULL AND text IN ('👍', '❤') GROUP BY ALL", "comments"))
def whole_talk_reactions(spark, d):
    return R.whole_talk_reactions(A.comments(spark, d))


@query(V("SELECT count(*)::BIGINT AS posts, count(*) FILTER (content_type = 'blog')::BIGINT AS blogs, count(*) FILTER (content_type = 'video')::BIGINT AS videos, count(DISTINCT author)::BIGINT AS authors FROM mentions WHERE parent_uri IS NULL", "mentions"))
def discussion_stats(spark, d):
    return R.discussion_stats(A.mentions(spark, d))


@query(V("SELECT content_type, count(*)::BIGINT AS n FROM mentions GROUP BY 1", "mentions"))
def content_type_counts(spark, d):
    return A.mentions(spark, d).groupBy("content_type").agg(F.count("*").alias("n"))


@query(V("SELECT concept_uri, list(talk_uri ORDER BY talk_uri) AS talks FROM talk_concepts GROUP BY 1", "talk_concepts"))
def concept_talks(spark, d):
    return A.talk_concepts(spark, d).groupBy("concept_uri").agg(F.array_sort(F.collect_set("talk_uri")).alias("talks"))


COUNTS = f"{MERGES}, counts AS (SELECT canonical, count(DISTINCT talk_uri)::BIGINT AS talks FROM talk_concepts JOIN merges USING (concept_uri) GROUP BY 1)"


@query(V(f"{COUNTS} SELECT * FROM counts", "talk_concepts"))
def merged_concept_talk_counts(spark, d):
    return R.merged_concept_talk_counts(A.talk_concepts(spark, d), merges(spark, d))


@query(V(f"{COUNTS} SELECT CASE WHEN talks = 1 THEN '1' WHEN talks <= 3 THEN '2-3' WHEN talks <= 10 THEN '4-10' ELSE '>10' END AS bucket, count(*)::BIGINT AS concepts FROM counts GROUP BY 1", "talk_concepts"))
def talk_count_histogram(spark, d):
    return R.talk_count_histogram(merged_concept_talk_counts(spark, d))


@query(V(f"{COUNTS} SELECT canonical, talks FROM counts ORDER BY talks DESC, canonical LIMIT 25", "talk_concepts"))
def top_concepts(spark, d):
    return merged_concept_talk_counts(spark, d).orderBy(F.desc("talks"), "canonical").limit(25)


@query(V(f"{COUNTS}, m AS (SELECT DISTINCT p_brand AS cluster, p_partkey - p_partkey % 3 AS canonical FROM part), r AS (SELECT cluster, canonical, p_name AS name, coalesce(talks, 0) AS talks FROM m JOIN part ON p_partkey = canonical LEFT JOIN counts USING (canonical)) SELECT cluster, sum(talks)::BIGINT AS total, list(concat_ws('|', canonical::VARCHAR, name, talks::VARCHAR) ORDER BY talks DESC, canonical) AS concepts FROM r GROUP BY 1", "talk_concepts"))
def cluster_rollup(spark, d):
    part = table(spark, d, "part")
    members = part.select(F.col("p_brand").alias("cluster"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("canonical"))
    names = part.select(F.col("p_partkey").alias("canonical"), F.col("p_name").alias("name"))
    return R.cluster_rollup(members, merged_concept_talk_counts(spark, d), names)


@query(V("SELECT uri, author, likes FROM mentions WHERE parent_uri IS NULL AND (content_type = 'post' OR content_type IS NULL) AND author NOT IN (7, 14) ORDER BY likes DESC, uri LIMIT 200", "mentions"))
def top_posts(spark, d):
    return R.top_posts(A.mentions(spark, d), blocked=(7, 14)).select("uri", "author", "likes")


@query(V(", r AS (SELECT uri, content_type, (row_number() OVER (PARTITION BY content_type ORDER BY likes DESC, uri))::INTEGER AS p, list_position(['post', 'blog', 'video', 'photo'], content_type) AS k FROM mentions WHERE parent_uri IS NULL) SELECT CASE WHEN content_type = 'post' AND p > 20 THEN 5 ELSE k END::INTEGER AS section, CASE WHEN content_type = 'post' AND p > 20 THEN p - 20 ELSE p END::INTEGER AS place, uri FROM r", "mentions"))
def discussion_feed(spark, d):
    return R.discussion_feed(A.mentions(spark, d))


@query(V("SELECT uri, CASE WHEN likes > 60 THEN 'liked' WHEN content_type = 'blog' THEN 'blogs' END AS search FROM mentions WHERE likes > 60 OR content_type = 'blog'", "mentions"))
def union_posts(spark, d):
    m = A.mentions(spark, d)
    return R.union_posts([("liked", m.where("likes > 60")), ("blogs", m.where("content_type = 'blog'"))]).select("uri", "search")


THREADS = "SELECT conv_id * 1000 + turn AS uri, CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent_uri FROM conversations"


@query(f"WITH p AS ({THREADS}), t AS (SELECT uri AS top FROM p WHERE parent_uri IS NULL), one AS (SELECT parent_uri AS top, uri FROM p WHERE parent_uri IN (SELECT top FROM t)) SELECT top, 1 AS depth, uri FROM one UNION ALL SELECT one.top, 2, p.uri FROM one JOIN p ON p.parent_uri = one.uri")
def flatten_threads(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    posts = table(spark, d, "conversations").select((c * 1000 + t).alias("uri"), F.when(t > 0, c * 1000 + F.floor((t - 1) / 2)).alias("parent_uri"))
    return R.flatten_threads(posts)


@query(V(", v AS (SELECT vod_uri, room, created_at - to_seconds(duration_s) AS s, created_at AS e FROM vods), h AS (SELECT t.uri, vod_uri, epoch(starts_at)::BIGINT - epoch(s)::BIGINT AS offset_s, least(epoch(e), epoch(ends_at))::BIGINT - epoch(starts_at)::BIGINT AS covered_s FROM schedule t JOIN v ON t.room = v.room AND s <= starts_at AND starts_at < e), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY uri ORDER BY covered_s DESC, vod_uri DESC, offset_s DESC) = 1) SELECT uri, vod_uri, offset_s, covered_s, CASE WHEN vod_uri IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM schedule LEFT JOIN b USING (uri)", "schedule", "vods"))
def time_window_match(spark, d):
    return R.time_window_match(A.schedule(spark, d), A.vods(spark, d))


@query(V(", j AS (SELECT g.*, abs(found_s - start_s) AS err FROM ground_truth g LEFT JOIN detected USING (doc_id) WHERE verified) SELECT count(*)::BIGINT AS verified, count(*) FILTER (err <= tolerance_s)::BIGINT AS passed, count(*) FILTER (err IS NULL)::BIGINT AS missed, round(avg(coalesce(err <= tolerance_s, false)::INT), 6) AS accuracy, round(sum(coalesce(err, 0)) / count(*), 6) AS mae, round(avg(err), 6) AS mae_found FROM j", "ground_truth", "detected"))
def boundary_score(spark, d):
    return R.boundary_score(A.ground_truth(spark, d), A.detected(spark, d))


FLAGS = ", f AS (SELECT l_orderkey || '-' || l_linenumber AS uri, l_quantity / 25 AS ratio, (l_partkey % 300) AS offset_s FROM lineitem), g AS (SELECT uri, list_filter([CASE WHEN ratio < 0.3 THEN 'WRONG_VOD' END, CASE WHEN ratio >= 0.3 AND ratio < 0.7 THEN 'SHORT' END, CASE WHEN ratio > 2 THEN 'MULTI_TALK' END, CASE WHEN offset_s > 120 THEN 'BIG_OFFSET' END], lambda x: x IS NOT NULL) AS flags FROM f)"


@query(f"WITH {FLAGS[2:]} SELECT * FROM g")
def alignment_flags(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uri"), F.col("l_quantity").alias("video_s"), F.lit(25.0).alias("scheduled_s"), (F.col("l_partkey") % 300).alias("offset_s"))
    return R.alignment_flags(rows)


@query(f"WITH {FLAGS[2:]} SELECT flag, count(*)::BIGINT AS n FROM (SELECT unnest(flags) AS flag FROM g) GROUP BY 1")
def flag_counts(spark, d):
    return R.flag_counts(alignment_flags(spark, d))


@query(V(f"{NAMES} SELECT uri, title FROM talks LEFT JOIN names ON uri = talk_uri WHERE contains(lower(title), '07') OR len(list_filter(speakers, lambda s: contains(lower(s), '07'))) > 0", "talks", "speakers", "talk_speakers"))
def filter_talks(spark, d):
    return R.filter_talks(talks_with_speakers(spark, d), "07").select("uri", "title")


@query(V(", t AS (SELECT speaker_uri, list(title) AS titles FROM talk_speakers JOIN talks ON talk_uri = uri GROUP BY 1) SELECT uri, name FROM speakers LEFT JOIN t ON uri = speaker_uri WHERE contains(name, '3') OR len(list_filter(titles, lambda x: contains(x, '77'))) > 0", "talks", "speakers", "talk_speakers"))
def filter_speakers(spark, d):
    titles = A.talk_speakers(spark, d).join(A.talks(spark, d), F.col("talk_uri") == F.col("uri")).groupBy("speaker_uri").agg(F.collect_list("title").alias("titles"))
    rows = A.speakers(spark, d).join(titles, F.col("uri") == F.col("speaker_uri"), "left")
    return rows.where(F.col("name").contains("3") | F.coalesce(F.exists("titles", lambda t: F.contains(t, F.lit("77"))), F.lit(False))).select("uri", "name")


@query("SELECT p_partkey AS uri, p_name AS term FROM part WHERE regexp_matches(p_name, '(?i)^(red|small) .*t$')")
def filter_terms(spark, d):
    return R.filter_terms(table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("term")), "^(red|small) .*t$")


@query("SELECT event_id, (ts - INTERVAL 7 HOUR)::DATE AS day FROM events")
def local_conference_day(spark, d):
    return table(spark, d, "events").select("event_id", R.local_day(F.col("ts").cast("timestamp")).alias("day"))


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages")
def distinct_hosts(spark, d):
    return R.distinct_hosts(table(spark, d, "pages"))


@query("SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1)) AS title FROM pages")
def og_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(V(", a AS (SELECT lower(name) AS text, uri FROM concepts UNION ALL SELECT lower(unnest(aliases)), uri FROM concepts), n AS (SELECT text, min(uri) AS uri FROM a WHERE text <> '' GROUP BY 1), e AS (SELECT uri AS entity_id, CASE uri % 3 WHEN 0 THEN 'The ' || name WHEN 1 THEN upper(name) ELSE name || ' x' END AS text FROM concepts) SELECT entity_id, e.text, coalesce(x.uri, y.uri) AS concept_uri FROM e LEFT JOIN n x ON lower(trim(e.text)) = x.text LEFT JOIN n y ON regexp_replace(lower(trim(e.text)), '^(the|a|an) ', '') = y.text", "concepts"))
def concept_link_entities(spark, d):
    c = A.concepts(spark, d)
    text = F.when(F.col("uri") % 3 == 0, F.concat(F.lit("The "), "name")).when(F.col("uri") % 3 == 1, F.upper("name")).otherwise(F.concat("name", F.lit(" x")))
    return E.concept_link(c.select(F.col("uri").alias("entity_id"), text.alias("text")), c)


@query(V(", k AS (SELECT *, replace(lower(name), ' ', '') AS cluster_key FROM concepts) SELECT cluster_key, arg_min(uri, (description IS NULL, length(name), uri)) AS canonical, count(*)::BIGINT AS n, list(DISTINCT name ORDER BY name) AS names, list_sort(list_distinct(flatten(list(aliases)))) AS aliases FROM k GROUP BY 1", "concepts"))
def concept_clusters(spark, d):
    return E.concept_clusters(A.concepts(spark, d))


PAIRS_SQL = "SELECT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_partkey % 40 < 30"


@query(f"WITH RECURSIVE p AS ({PAIRS_SQL}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS root FROM r GROUP BY 1")
def merge_components(spark, d):
    key = F.col("p_partkey")
    return E.merge_components(table(spark, d, "part").where(key % 40 < 30).select(key.alias("a"), (key + 7).alias("b")))


@query(V(f"{MERGES} SELECT talk_uri, coalesce(canonical, concept_uri) AS concept_uri, sum(mention_count)::BIGINT AS mention_count FROM talk_concepts LEFT JOIN merges USING (concept_uri) GROUP BY ALL", "talk_concepts"))
def rewire_concepts(spark, d):
    return E.rewire_concepts(A.talk_concepts(spark, d), merges(spark, d))


@query("SELECT coalesce(m.into_, p_brand) AS cluster, list(DISTINCT coalesce(a.into_, p_partkey) ORDER BY coalesce(a.into_, p_partkey)) AS members FROM part LEFT JOIN (SELECT p_partkey AS member, p_partkey - 1 AS into_ FROM part WHERE p_partkey % 2 = 1) a ON member = p_partkey LEFT JOIN (VALUES ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#4')) m(c, into_) ON m.c = p_brand GROUP BY 1")
def apply_cluster_edits(spark, d):
    part = table(spark, d, "part")
    absorb = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("member"), (F.col("p_partkey") - 1).alias("into"))
    merge = spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "Brand#4")], "cluster string, into string")
    return E.apply_cluster_edits(part.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("member")), absorb, merge)


@query("SELECT s_suppkey AS uri, s_name AS name FROM supplier WHERE length(s_name) > 0 ORDER BY length(s_name), s_name LIMIT 200")
def known_names_sample(spark, d):
    return A.speakers(spark, d).orderBy(F.length("name"), "name").limit(200)


@query(V("SELECT doc_id, array_to_string(ws[1:400], ' ') AS head, array_to_string(ws[greatest(len(ws) - 149, 1):], ' ') AS tail, len(ws)::BIGINT AS n FROM token_lists", "token_lists"))
def talk_text_extract(spark, d):
    words = T.tokenize_ws(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", words.alias("ws"))
    return rows.select("doc_id", F.array_join(F.slice("ws", 1, 400), " ").alias("head"), F.array_join(F.slice("ws", F.greatest(F.size("ws") - 149, F.lit(1)), 150), " ").alias("tail"), F.size("ws").cast("long").alias("n"))


@query("SELECT doc_id, regexp_extract_all(text, '@([A-Za-z0-9_.-]+)', 1) AS handles FROM documents WHERE contains(text, '@')")
def extract_handles(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", T.extract_handles(F.col("text")).alias("handles"))


@query("SELECT doc_id, CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') ELSE (n_chars // 60) || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') END AS t FROM documents")
def format_time(spark, d):
    return table(spark, d, "documents").select("doc_id", T.format_time(F.col("n_chars")).alias("t"))


@query("SELECT p_partkey AS uri, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '! (x)'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '! (x)'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def normalize_titles(spark, d):
    name = F.concat("p_name", F.lit(" / "), "p_type", F.lit("! (x)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), T.normalize_title(name).alias("title"), T.slugify(name).alias("slug"))


@query("WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id AS uri, epoch_us(ts) AS time_us, event_id AS rev, props AS record FROM u WHERE k = 1 AND event_type <> 'error'")
def upsert_latest(spark, d):
    """The record tables' state after all commits: newest commit of each uri, deleted ones gone."""
    from spanloom.sources.records import latest_state

    return latest_state(A.commits(spark, d)).select("uri", "time_us", "rev", "record")


@query("SELECT event_id, user_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type <> 'error'")
def project_record(spark, d):
    from spanloom.sources.records import project_records

    rows = table(spark, d, "events").where("event_type <> 'error'").select("event_id", "user_id", F.col("props").alias("record"))
    return project_records(rows, "k long", ["event_id", "user_id"])


@query("SELECT custkey AS uri, coalesce(n.total, o.total) AS total, CASE WHEN n.status IS NULL OR n.status = 'P' THEN coalesce(o.status, n.status) ELSE n.status END AS status, greatest(coalesce(o.flag, 0), coalesce(n.flag, 0)) AS flag FROM (SELECT o_custkey AS custkey, max(o_totalprice) AS total, max(o_orderstatus) AS status, 1 AS flag FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT o_custkey AS custkey, max(o_totalprice) AS total, min(o_orderstatus) AS status, 0 AS flag FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) n USING (custkey)")
def upsert_merge_columns(spark, d):
    from spanloom.sources.records import merge_columns

    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("uri")).agg(F.max("o_totalprice").alias("total"), F.max("o_orderstatus").alias("status"), F.lit(1).alias("flag"))
    new = o.where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("uri")).agg(F.max("o_totalprice").alias("total"), F.min("o_orderstatus").alias("status"), F.lit(0).alias("flag"))
    return merge_columns(old, new, "uri", {"total": "coalesce", "status": ("keep_if", "P"), "flag": "sticky"})


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4000 THEN NULL ELSE text END AS text, lang FROM documents")
def payload_cap(spark, d):
    from spanloom.sources.records import payload_cap as cap

    return cap(table(spark, d, "documents").select("doc_id", "text", "lang"), "text", 4000)


@query("SELECT o_orderkey AS talk_key, o_orderpriority AS where_, o_orderdate AS starts FROM orders")
def apply_lens(spark, d):
    from spanloom.sources.lens import apply_lens as lens

    rows = table(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderpriority").alias("room")).alias("place")).alias("event"), F.col("o_orderdate").alias("date"), F.col("o_custkey"))
    return lens(rows, [("event.key", "talk_key"), ("event.place.room", "where_"), ("date", "starts")], passthrough=False)


@query(V("SELECT stream, at_s, pos FROM (SELECT s.stream, s.at_s, w.pos, row_number() OVER (PARTITION BY s.stream, s.at_s ORDER BY abs(w.start_ms / 1000 - s.at_s), w.start_ms) AS k FROM (SELECT DISTINCT doc_id::VARCHAR AS stream, doc_id, unnest([4.0, 11.0, 31.0])::DOUBLE AS at_s FROM words) s JOIN words w ON w.doc_id = s.doc_id) WHERE k = 1", "words"))
def nearest_word_anchor(spark, d):
    from spanloom.operators.intervals import as_of

    w = A.words(spark, d).select(F.col("doc_id").cast("string").alias("stream"), "pos", (F.col("start_ms") / 1000).alias("w_s"))
    points = w.select("stream").distinct().withColumn("at_s", F.explode(F.array(F.lit(4.0), F.lit(11.0), F.lit(31.0))))
    back = as_of(points, w.select("stream", F.col("w_s").alias("b_s"), F.col("pos").alias("b_pos")), ["stream"], "at_s", "b_s")
    both = as_of(back, w.select("stream", F.col("w_s").alias("f_s"), F.col("pos").alias("f_pos")), ["stream"], "at_s", "f_s", forward=True)
    nearer = F.col("b_s").isNotNull() & (F.col("f_s").isNull() | (F.col("at_s") - F.col("b_s") <= F.col("f_s") - F.col("at_s")))
    return both.select("stream", "at_s", F.when(nearer, F.col("b_pos")).otherwise(F.col("f_pos")).alias("pos"))


@query(V("SELECT author AS speaker, count(*)::BIGINT AS posts FROM mentions GROUP BY 1 ORDER BY posts DESC, speaker LIMIT 20", "mentions"))
def top_mentioned(spark, d):
    return A.mentions(spark, d).groupBy(F.col("author").alias("speaker")).agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "speaker").limit(20)


@query(V("SELECT uri, upper(name[1]) AS letter FROM concepts", "concepts"))
def letter_headings(spark, d):
    return A.concepts(spark, d).select("uri", F.upper(F.substring("name", 1, 1)).alias("letter"))


@query(("SELECT doc_id, ordinal, text FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS ordinal, trim(piece, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM (SELECT doc_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS piece FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), '[^' || chr(1) || ']+') AS ps FROM documents))) WHERE text <> ''"))
def sentence_spans(spark, d):
    from pyspark.sql import Window as W

    rows = S.sentence_rows(table(spark, d, "documents"))
    return rows.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1).cast("long").alias("ordinal"), F.trim(F.col("text"), F.lit(" \t\n\r")).alias("text"))
