"""Queries on documents as spans, on text expressions, and on files and streams of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import boundaries as B
from spanloom.operators import entities as E
from spanloom.operators import sequence as S
from spanloom.operators import spans as P
from spanloom.sources import records as C
from spanloom.sources.files import read_sidecar_list, scratch_dir
from spanloom.sources.lens import resolve_lens as lens_between
from spanloom.streaming import commits as stream
from spanloom.streaming import rebuild

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query
from .timed import blocks_sql

# --- text expressions -----------------------------------------------------------


@query(r"SELECT p_partkey AS uri, array_to_string([x FOR x IN regexp_split_to_array(lower(p_name || '/' || p_type || '-' || p_brand), '[\s\-_/]+') IF x <> ''], '|') AS parts FROM part")
def tokenize_name(spark, d):
    name = F.concat_ws("", "p_name", F.lit("/"), "p_type", F.lit("-"), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.array_join(T.tokenize_name(name), "|").alias("parts"))


ENDINGS = [a for a, _ in T.SPELLING]


@query(
    "WITH w AS (SELECT p_partkey AS uri, string_split(p_name, ' ')[1] || (["
    + ", ".join(f"'{e}'" for e in ENDINGS)
    + f"])[p_partkey % {len(ENDINGS)} + 1] AS w FROM part) SELECT uri, CASE "
    + " ".join(f"WHEN ends_with(w, '{a}') THEN left(w, length(w) - {len(a)}) || '{b}'" for a, b in T.SPELLING)
    + " ELSE w END AS lemma FROM w"
)
def lemma(spark, d):
    """Words of names with each of the British endings."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    word = F.concat(F.split("p_name", " ")[0], ending)
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), T.american_spelling(word).alias("lemma"))


SHORT = {"standard": "std", "large": "lg", "small": "sm", "economy": "eco"}


@query("SELECT p_partkey AS uri, CASE lower(trim(string_split(p_type, ' ')[1])) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT.items()) + " END AS expansion FROM part")
def expand_abbreviation(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), T.expand_abbreviation(F.split("p_type", " ")[0], SHORT).alias("expansion"))


@query(f"SELECT doc_id, substr(trim(regexp_replace(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 512) AS slug FROM documents")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT event_id, 'did:u' || user_id AS did, event_id::VARCHAR AS rkey FROM events")
def at_uri_parts(spark, d):
    uri = F.concat(F.lit("at://did:u"), "user_id", F.lit("/c."), "event_type", F.lit("/"), "event_id")
    return table(spark, d, "events").select("event_id", T.at_uri_did(uri).alias("did"), T.at_uri_rkey(uri).alias("rkey"))


@query(V(r"SELECT uri, length(trim(text)) + length(regexp_replace(trim(text), '[^\x{10000}-\x{10FFFF}]', '', 'g')) <= 2 AND NOT regexp_matches(text, '[A-Za-z]') AS is_reaction FROM comments", "comments"))
def is_emoji_reaction(spark, d):
    return A.comments(spark, d).select("uri", T.is_emoji_reaction(F.col("text")).alias("is_reaction"))


def page_posts(spark, d):
    """Pages as posts: their text, and facets with their own address and, for each third, a video's."""
    video = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://clips.example.org/v/"), "page_id"))
    feature = lambda u: F.struct(F.array(F.struct(u.alias("uri"))).alias("features"))
    return table(spark, d, "pages").select("page_id", F.col("html").alias("text"), F.array(feature(F.col("url")), feature(video)).alias("facets"))


POSTS = "WITH p AS (SELECT page_id, html, [u FOR u IN [url, CASE WHEN page_id % 3 = 0 THEN 'https://clips.example.org/v/' || page_id END] IF u IS NOT NULL] AS links, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, url FROM pages), k AS (SELECT *, page_id % 3 = 0 OR ends_with(host, 'example.net') AS video, NOT ends_with(host, 'example.net') AS other FROM p), c AS (SELECT *, CASE WHEN video THEN 'video' WHEN other AND regexp_matches(lower(html), 'wrote|recap|writeup|blog|reflection') THEN 'blog' ELSE 'post' END AS kind FROM k)"
VIDEO = ("clips.example.org", "example.net")


@query(f"{POSTS} SELECT page_id, array_to_string(links, ' ') AS links FROM c")
def extract_links(spark, d):
    return page_posts(spark, d).select("page_id", F.array_join(T.extract_links(F.col("facets")), " ").alias("links"))


@query(f"{POSTS} SELECT page_id, kind FROM c")
def classify_post(spark, d):
    return page_posts(spark, d).select("page_id", T.classify_post(F.col("text"), T.extract_links(F.col("facets")), VIDEO).alias("kind"))


@query(f"{POSTS} SELECT page_id, CASE WHEN kind = 'video' AND NOT ends_with(host, 'example.net') THEN links[2] ELSE links[1] END AS url FROM c")
def primary_url(spark, d):
    links = T.extract_links(F.col("facets"))
    return page_posts(spark, d).select("page_id", T.primary_url(T.classify_post(F.col("text"), links, VIDEO), links, VIDEO, "home.example.com").alias("url"))


# --- spans and layers -----------------------------------------------------------

STAMPS = "SELECT doc_id, 'timestamp' AS kind, byte_start, byte_end, (start_ms * 1000000)::VARCHAR || '-' || (end_ms * 1000000)::VARCHAR AS value FROM words"
ENTITIES = "SELECT subject_uri AS doc_id, CASE WHEN author % 5 = 0 THEN 'speaker-ref' WHEN author % 3 = 0 THEN 'concept-ref' ELSE 'entity' END AS kind, byte_start, byte_end, CASE WHEN author % 5 = 0 THEN 'did:' || author WHEN author % 3 = 0 THEN 'concept:' || author ELSE text END AS value FROM comments WHERE byte_start IS NOT NULL"


def entities(spark, d):
    a = F.col("author")
    rows = A.comments(spark, d).where("byte_start is not null").withColumnRenamed("subject_uri", "doc_id")
    return P.entity_spans(rows.withColumns({"label": F.col("text"), "speaker_did": F.when(a % 5 == 0, F.concat(F.lit("did:"), a)), "concept_uri": F.when(a % 3 == 0, F.concat(F.lit("concept:"), a))}))


@query(V(STAMPS, "words"))
def decode_to_spans(spark, d):
    return P.timestamp_spans(A.words(spark, d))


@query(V(ENTITIES, "comments"))
def entity_spans(spark, d):
    return entities(spark, d)


@query(V("SELECT doc_id, (pos // 2000)::INTEGER AS chunk, pos, byte_start, byte_end, start_ms, end_ms FROM words", "words"))
def transcript_to_layers(spark, d):
    """Both kinds of tokens of each record, side by side again."""
    layers = P.token_layers(A.listed_words(spark, d))
    return layers.select("doc_id", "chunk", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("doc_id", "chunk", "t.tokens.pos", "t.tokens.byte_start", "t.tokens.byte_end", "t.times.start_ms", "t.times.end_ms")


@query(V(f"{STAMPS} UNION ALL {ENTITIES}", "words", "comments"))
def layers_to_document(spark, d):
    return P.layers_to_spans(P.token_layers(A.listed_words(spark, d)), entities(spark, d))


FACETS = f", f AS ({STAMPS} UNION ALL {ENTITIES}), s AS (SELECT f.* FROM f SEMI JOIN documents USING (doc_id))"


@query(V(f"{FACETS} SELECT doc_id, count(s.kind)::BIGINT AS n_facets, md5(coalesce(string_agg(concat_ws(' ', s.byte_start, s.byte_end, s.kind, s.value), ',' ORDER BY s.byte_start, s.byte_end, s.kind, s.value), '')) AS facets_md5 FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id", "words", "comments"))
def document_with_structure(spark, d):
    docs = P.assemble_transcripts(A.timed_transcripts(spark, d), entities(spark, d))
    written = F.array_join(F.transform("facets", lambda f: F.concat_ws(" ", f["byte_start"].cast("string"), f["byte_end"].cast("string"), f["kind"], f["value"])), ",")
    return docs.select("doc_id", F.coalesce(F.size("facets"), F.lit(0)).cast("long").alias("n_facets"), F.md5(F.coalesce(written, F.lit(""))).alias("facets_md5"))


@query(V(f"{FACETS} SELECT * FROM s", "words", "comments"))
def extract_document(spark, d):
    return P.extract_document(P.assemble_transcripts(A.timed_transcripts(spark, d), entities(spark, d)))


@query(V("SELECT doc_id, pos, CASE WHEN pos % 9 = 8 THEN -1 ELSE pos // 9 END::BIGINT AS sentence, (pos // 40)::BIGINT AS paragraph FROM words", "words"))
def span_hierarchy(spark, d):
    """Sentences of eight words, each followed by a word of its own; paragraphs of forty."""
    w = A.placed_words(spark, d)

    def spans(size: int, used: int):
        rows = w.where(F.col("pos") % size < used).groupBy("doc_id", F.floor(F.col("pos") / size).alias("ordinal"))
        return rows.agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))

    return P.span_hierarchy(w, spans(9, 8), spans(40, 40))


@query(V("SELECT doc_id, run, any_value(speaker) AS speaker, min(byte_start) AS byte_start, max(byte_end) AS byte_end FROM (SELECT *, (pos // 17 + 1)::BIGINT AS run, 'S' || (pos // 17 % 3) AS speaker FROM words) GROUP BY ALL", "words"))
def speaker_runs(spark, d):
    turn = F.floor(F.col("pos") / 17)
    return P.speaker_runs(A.words(spark, d).withColumn("speaker", F.concat(F.lit("S"), (turn % 3).cast("string"))))


@query(r"""
WITH RECURSIVE c AS (
  SELECT doc_id, -1 AS chunk, NULL::VARCHAR AS piece, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk + 1, CASE WHEN length(rest) <= 8000 THEN rest WHEN m > 2 THEN substr(rest, 1, m - 1) ELSE substr(rest, 1, 8000) END,
    CASE WHEN length(rest) <= 8000 THEN NULL WHEN m > 2 THEN substr(rest, m + 1) ELSE substr(rest, 8001) END
  FROM (SELECT *, length(regexp_extract(substr(rest, 1, 8000), '^(?s:.*)[.?!] ')) AS m FROM c WHERE rest IS NOT NULL))
SELECT doc_id, chunk, length(piece)::BIGINT AS chars, md5(piece) AS piece_md5 FROM c WHERE chunk >= 0""")
def chunk_text(spark, d):
    rows = P.chunk_text(table(spark, d, "documents"))
    return rows.select("doc_id", "chunk", F.length("text").cast("long").alias("chars"), F.md5("text").alias("piece_md5"))


# --- matching and chains --------------------------------------------------------


@query("SELECT o_orderkey AS uri FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def unmatched_schedule(spark, d):
    """Talks without a recording of 45 minutes or more."""
    matched = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("uri"))
    return P.unassigned(A.schedule(spark, d).select("uri"), matched, "uri")


@query(V("SELECT uri FROM concepts WHERE uri NOT IN (SELECT concept_uri FROM talk_concepts WHERE mention_count > 1)", "concepts", "talk_concepts"))
def unassigned_concepts(spark, d):
    often = A.talk_concepts(spark, d).where("mention_count > 1").select(F.col("concept_uri").alias("uri"))
    return P.unassigned(A.concepts(spark, d).select("uri"), often, "uri")


@query("SELECT p_partkey AS uri, p_brand AS source, p_type AS target FROM part WHERE p_brand = (SELECT p_brand FROM part ORDER BY p_partkey LIMIT 1) AND p_type = (SELECT p_type FROM part ORDER BY p_partkey LIMIT 1) ORDER BY uri LIMIT 1")
def resolve_lens(spark, d):
    """Parts as lenses from brand to container; the pair of the first part."""
    lenses = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_brand").alias("source"), F.col("p_type").alias("target"))
    pair = lenses.orderBy("uri").first()
    return lens_between(lenses, pair["source"], pair["target"])


@query("SELECT p_brand AS cluster, count(*)::BIGINT AS members FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_clusters(spark, d):
    return E.top_clusters(table(spark, d, "part").select(F.col("p_brand").alias("cluster")))


PAUSES = blocks_sql("diarization", 5) + ", gaps AS (SELECT stream, start_s AS at_s, start_s - lag(end_s) OVER (PARTITION BY stream ORDER BY block) AS gap_s FROM blocks QUALIFY gap_s >= 3), scored AS (SELECT stream, at_s, CASE WHEN gap_s >= 60 THEN 25.0::DOUBLE WHEN gap_s >= 30 THEN 15 + (gap_s - 30) / 3 ELSE least(15.0::DOUBLE, gap_s * 0.5) END AS score FROM gaps)"


def pauses(spark, d):
    """(stream, at_s, score): gaps of three seconds or more between speech blocks, scored by length."""
    from pyspark.sql import Window as W

    o = W.partitionBy("stream").orderBy("block")
    rows = S.speech_blocks(A.diarization(spark, d)).select("stream", F.col("start_s").alias("at_s"), (F.col("start_s") - F.lag("end_s").over(o)).alias("gap_s")).where("gap_s >= 3")
    return rows.select("stream", "at_s", B.transition_score(F.col("gap_s"), F.lit(""), F.lit("")).alias("score"))


@query(V(f"{PAUSES} SELECT stream, at_s, CASE WHEN score >= 15 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS label FROM scored", "diarization"))
def confidence_label(spark, d):
    return pauses(spark, d).select("stream", "at_s", T.confidence_label(F.col("score"), F.lit(False)).alias("label"))


@query(V(f"{PAUSES}, u AS (SELECT stream, min(start_s) + 600 AS usable_s FROM diarization GROUP BY 1), c AS (SELECT s.stream, at_s, score + CASE WHEN floor(at_s)::BIGINT % 4 = 0 THEN 6 ELSE 0 END AS v, floor(at_s)::BIGINT % 4 = 0 AS lifted FROM scored s JOIN u ON u.stream = s.stream AND at_s >= usable_s AND at_s < usable_s + 2700), b AS (SELECT stream, at_s FROM c WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY v DESC, lifted, at_s) = 1) SELECT u.stream, coalesce(b.at_s, usable_s) AS start_s FROM u LEFT JOIN b USING (stream)", "diarization"))
def first_talk_start(spark, d):
    gaps = pauses(spark, d)
    usable = A.diarization(spark, d).groupBy("stream").agg((F.min("start_s") + 600).alias("usable_s"))
    bonus = gaps.where(F.floor("at_s") % 4 == 0).select("stream", "at_s", F.lit(6.0).alias("bonus"))
    return B.first_talk_start(gaps, usable, bonus)


@query(V(f"""
{PAUSES}, t AS (SELECT DISTINCT stream FROM diarization),
g AS (SELECT stream, list(DISTINCT at_s) AS gs FROM scored GROUP BY 1)
SELECT * FROM (
WITH RECURSIVE c AS (
  SELECT t.stream, 0 AS place, 300.0::DOUBLE AS at_s, false AS found, gs FROM t LEFT JOIN g ON g.stream = t.stream
  UNION ALL
  SELECT stream, place + 1, coalesce(best, expected), best IS NOT NULL, gs FROM (
    SELECT *, (list_sort([{{'far': abs(x - expected), 'at': x}} FOR x IN gs IF abs(x - expected) <= 900]))[1].at AS best
    FROM (SELECT *, at_s + 1500 + 60 * place AS expected FROM c WHERE place < 9)))
SELECT stream, place, stream || '/' || place AS talk, at_s, found FROM c)""", "diarization"))
def anchor_chain(spark, d):
    """Ten talks a stream, each a minute longer than the one before."""
    talks = A.diarization(spark, d).select("stream").distinct().select("stream", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("place"))
    talks = talks.select("stream", "place", F.concat_ws("/", "stream", F.col("place").cast("string")).alias("talk"), (1500.0 + 60 * F.col("place")).alias("duration_s"), F.lit(300.0).alias("first_s"))
    return B.anchor_chain(talks, pauses(spark, d))


@query(V("""
, z AS (SELECT stream, event_id AS zone, start_s AS a, start_s + 2400 AS b FROM diarization WHERE event_id % 40 = 0),
i AS (SELECT z.stream, zone, event_id, start_s AS o, greatest(start_s, a) AS s, least(end_s, b) AS e FROM z JOIN diarization g ON g.stream = z.stream AND start_s < b AND end_s > a),
f AS (SELECT *, coalesce((s - lag(e) OVER w >= 5)::INT, 1) AS fresh FROM i WINDOW w AS (PARTITION BY stream, zone ORDER BY o, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY stream, zone ORDER BY o, event_id ROWS UNBOUNDED PRECEDING) AS block FROM f),
bl AS (SELECT stream, zone, block, arg_min(s, (o, event_id)) AS s, arg_max(e, (o, event_id)) AS e FROM n GROUP BY ALL),
r AS (SELECT * FROM (WITH RECURSIVE c AS (
  SELECT stream, zone, block, 0 AS chunk, s AS start_s, e AS end_s FROM bl WHERE block = 1
  UNION ALL
  SELECT c.stream, c.zone, bl.block, CASE WHEN bl.e - start_s <= 1200 THEN chunk ELSE chunk + 1 END, CASE WHEN bl.e - start_s <= 1200 THEN start_s ELSE bl.s END, bl.e
  FROM c JOIN bl ON bl.stream = c.stream AND bl.zone = c.zone AND bl.block = c.block + 1) SELECT * FROM c))
SELECT stream, zone, chunk, any_value(start_s) AS start_s, arg_max(end_s, block) AS end_s FROM r GROUP BY stream, zone, chunk""", "diarization"))
def zone_speech_chunks(spark, d):
    """Forty minutes from each fortieth segment on as zones."""
    di = A.diarization(spark, d)
    zones = di.where("event_id % 40 = 0").select("stream", F.col("event_id").alias("zone"), F.col("start_s").alias("zone_start"), (F.col("start_s") + 2400).alias("zone_end"))
    return S.zone_speech_chunks(zones, di)


@query(V(", h AS (SELECT a.doc_id, a.pos, a.start_ms, b.end_ms FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.pos = a.pos + 3 WHERE a.pos % 50 = 0) SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, 'Thank you for watching' AS pattern FROM h GROUP BY 1 HAVING count(*) >= 3", "words"))
def phrase_loop_zones(spark, d):
    """Each fiftieth word begins a phrase of thanks."""
    said = F.element_at(F.array(*map(F.lit, ("thank", "you", "for", "watching"))), F.least(F.col("pos") % 50 + 1, F.lit(4)))
    return S.phrase_loop_zones(A.words(spark, d).withColumn("word", F.when(F.col("pos") % 50 < 4, said).otherwise(F.col("word"))))


# --- files and streams ----------------------------------------------------------


@query("SELECT 'did:p' || page_id AS did, 'c.page' AS collection, page_id::VARCHAR AS rkey, url FROM pages")
def read_records(spark, d):
    """Pages written as JSON lines and read back."""
    path = scratch_dir(spark, "records")
    uri = F.concat(F.lit("at://did:p"), "page_id", F.lit("/c.page/"), "page_id")
    table(spark, d, "pages").select(F.to_json(F.struct(uri.alias("uri"), F.struct("url", "html").alias("value")))).write.text(path)
    return C.read_records(spark, path, "c.page").select("did", "collection", "rkey", F.get_json_object("record", "$.url").alias("url"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def read_sidecars(spark, d):
    """The nations as one curated JSON list."""
    path = scratch_dir(spark, "sidecar")
    one = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    table(spark, d, "nation").agg(F.to_json(F.collect_list(one))).write.text(path)
    return read_sidecar_list(spark, path, "id long, name string, region long")


@query("SELECT 'at://did:p' || page_id || '/c.page/' || page_id AS uri, 'create' AS operation, 0::BIGINT AS time_us, url FROM pages")
def as_commit_events(spark, d):
    uri = F.concat(F.lit("at://did:p"), "page_id", F.lit("/c.page/"), "page_id")
    rows = table(spark, d, "pages").select(F.concat(F.lit("did:p"), "page_id").alias("did"), F.lit("c.page").alias("collection"), F.col("page_id").cast("string").alias("rkey"), uri.alias("uri"), F.to_json(F.struct("url")).alias("record"))
    return C.as_commit_events(rows).select("uri", "operation", "time_us", F.get_json_object("record", "$.url").alias("url"))


def commit_lines(spark, d):
    """Events as JSON lines of commits: users are records, errors delete."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    commit = F.concat(F.lit('{"operation":"'), kind, F.lit('","collection":"c.user","rkey":"'), "user_id", F.lit('","rev":"'), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit('","record":'), "props", F.lit("}"))
    return table(spark, d, "events").select(F.concat(F.lit('{"did":"did:e'), F.col("event_id") % 7, F.lit('","kind":"commit","time_us":'), time, F.lit(',"commit":'), commit, F.lit("}")).alias("value"))


LOG = "SELECT 'at://did:e' || event_id % 7 || '/c.user/' || user_id AS uri, 'did:e' || event_id % 7 AS did, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'update' END AS operation, epoch_us(ts) AS time_us, event_id, json_extract_string(props, '$.k') AS k FROM events"
NEWEST = f"WITH l AS ({LOG}), n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY uri ORDER BY time_us DESC, event_id DESC) = 1)"


def streamed(spark, d, runs: int = 1, after=None):
    """The commit log after a stream over files of commits, stopped and started again ``runs`` - 1 times."""
    source, out = scratch_dir(spark, "commits"), scratch_dir(spark, "log")
    log = stream.CommitLog(spark, f"{out}/rows")
    lines = commit_lines(spark, d)
    for k in range(runs):
        part = lines.where(F.pmod(F.xxhash64("value"), F.lit(runs)) == k)
        part.write.mode("append").text(source)
        stream.stream_index(stream.commit_stream(spark, source), log, f"{out}/checkpoint", ["c.user"], after=after).awaitTermination()
    return log


@query(f"{NEWEST} SELECT uri, did, time_us, k FROM n WHERE operation <> 'delete'")
def stream_index(spark, d):
    return stream.live(streamed(spark, d).read()).select("uri", "did", "time_us", F.get_json_object("record", "$.k").alias("k"))


@query(f"{NEWEST} SELECT uri, did, time_us, k FROM n WHERE operation <> 'delete'")
def stream_resume(spark, d):
    """The same in three runs of the stream over one checkpoint, commits in no order."""
    return stream.live(streamed(spark, d, 3).read()).select("uri", "did", "time_us", F.get_json_object("record", "$.k").alias("k"))


@query(f"{NEWEST} SELECT uri, time_us FROM n WHERE operation = 'delete'")
def stream_deletes(spark, d):
    return streamed(spark, d).read().where("record is null").select("uri", "time_us")


@query(f"WITH l AS ({LOG}) SELECT uri, did, operation, time_us, k FROM l")
def commit_stream(spark, d):
    """All commits of the stream as they come, through a stream that appends them."""
    source, out = scratch_dir(spark, "commits"), scratch_dir(spark, "stream")
    commit_lines(spark, d).write.text(source)
    rows = stream.commit_stream(spark, source).select("uri", "did", "operation", "time_us", F.get_json_object("record", "$.k").alias("k"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("uri string, did string, operation string, time_us long, k string").parquet(f"{out}/rows")


@query("SELECT DISTINCT 'did:e' || event_id % 7 AS did FROM events WHERE event_id % 7 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def stream_new_authors(spark, d):
    known = A.profiles(spark, d).select(F.concat(F.lit("did:e"), "did").alias("did"))
    return stream.new_authors(C.parse_commit_events(commit_lines(spark, d)), known)


@query(f"WITH l AS ({LOG}) SELECT uri, time_us FROM l WHERE time_us >= (SELECT max(time_us) FROM l) - 72 * 3600000000")
def stream_max_age(spark, d):
    rows = C.parse_commit_events(commit_lines(spark, d))
    now = rows.agg(F.max("time_us")).first()[0]
    return C.stream_max_age(rows, now).select("uri", "time_us")


@query(V("""SELECT doc_id, 'sentence-boundary' AS subkind, byte_start, byte_end, 'sentence' AS label, '' AS features FROM words WHERE pos % 9 = 0
UNION ALL SELECT doc_id, 'paragraph-boundary', byte_start, byte_end, 'paragraph', '' FROM words WHERE pos % 40 = 0
UNION ALL SELECT doc_id, 'topic-segment', byte_start, byte_start, 'topic-break', '' FROM words WHERE pos % 100 = 50
UNION ALL SELECT subject_uri, 'ner', byte_start, byte_end, text, concat_ws(',', 'nerType=' || (author % 4), CASE WHEN author % 5 = 0 THEN 'speakerDid=did:' || author END, CASE WHEN author % 3 = 0 THEN 'conceptUri=c:' || author END) FROM comments WHERE byte_start IS NOT NULL""", "words", "comments"))
def nlp_to_layers(spark, d):
    """Words at fixed places as sentences, paragraphs and topics; anchored comments as entities."""
    w, a = A.words(spark, d), F.col("author")
    found = A.comments(spark, d).where("byte_start is not null").select(
        F.col("subject_uri").alias("doc_id"), "byte_start", "byte_end", F.col("text").alias("label"), (a % 4).alias("nerType"), F.when(a % 5 == 0, F.concat(F.lit("did:"), a)).alias("speakerDid"), F.when(a % 3 == 0, F.concat(F.lit("c:"), a)).alias("conceptUri")
    )
    rows = P.nlp_to_layers(w.where("pos % 9 = 0"), w.where("pos % 40 = 0"), found, w.where("pos % 100 = 50"))
    listed = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.withColumn("features", F.coalesce(listed, F.lit("")))


def record_commits(spark, d):
    """Commits of every document's expression, its segmentations of 500 words and, where it has comments, a layer of entities."""
    e = lambda c: F.concat(F.lit("e"), c)
    texts = table(spark, d, "documents").where("text is not null").select(e("doc_id").alias("uri"), F.lit("x.expression").alias("collection"), F.to_json(F.struct("text")).alias("record"))
    layers = P.token_layers(A.listed_words(spark, d), 500)
    lists = lambda c, *names: F.transform(c, lambda t: F.array(*[t[n].cast("long") for n in names]))
    parts = F.struct(e("doc_id").alias("expression"), lists("tokens", "pos", "byte_start", "byte_end").alias("tokens"), lists("times", "pos", "start_ms", "end_ms").alias("times"))
    segments = layers.select(F.concat(e("doc_id"), F.lit("/s"), "chunk").alias("uri"), F.lit("x.segmentation").alias("collection"), F.to_json(parts).alias("record"))
    notes = F.struct("kind", F.col("byte_start").cast("long").alias("byteStart"), F.col("byte_end").cast("long").alias("byteEnd"), "value")
    found = entities(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(notes)).alias("annotations"))
    layer = found.select(F.concat(e("doc_id"), F.lit("/ner")).alias("uri"), F.lit("x.annotationLayer").alias("collection"), F.to_json(F.struct(e("doc_id").alias("expression"), "annotations")).alias("record"))
    rows = texts.union(segments).union(layer)
    return rows.select("uri", "collection", F.lit("create").alias("operation"), F.lit(1).cast("long").alias("time_us"), F.lit("r").alias("rev"), "record")


@query(V(f"{FACETS}, r AS (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) FILTER (kind = 'timestamp') > 0 AND count(*) FILTER (kind <> 'timestamp') > 0) SELECT doc_id, count(*)::BIGINT AS n_facets, md5(string_agg(concat_ws(' ', s.byte_start, s.byte_end, s.kind, s.value), ',' ORDER BY s.byte_start, s.byte_end, s.kind, s.value)) AS facets_md5 FROM s SEMI JOIN r USING (doc_id) GROUP BY doc_id", "words", "comments"))
def stream_rebuild_documents(spark, d):
    """The commits in no order, in two runs of the stream over one checkpoint."""
    source, out = scratch_dir(spark, "records"), scratch_dir(spark, "rebuilt")
    rows = record_commits(spark, d)  # made for each run, which costs less than one more copy of all records on disk
    for k in range(2):
        rows.where(F.pmod(F.xxhash64("uri"), F.lit(2)) == k).write.mode("append").parquet(source)
        stream = rebuild.rebuild_stream(spark.readStream.schema(rows.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    docs = rebuild.newest_documents(spark.read.parquet(f"{out}/rows"))
    listed = F.array_join(F.transform("facets", lambda f: F.concat_ws(" ", f["byte_start"].cast("string"), f["byte_end"].cast("string"), f["kind"], f["value"])), ",")
    return docs.select(F.substring("expression", 2, 20).cast("long").alias("doc_id"), F.size("facets").cast("long").alias("n_facets"), F.md5(listed).alias("facets_md5"))
