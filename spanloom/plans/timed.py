"""Queries on words, speaker segments, gaps and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import timing
from spanloom.operators import index, intervals
from spanloom.operators import sequence as S

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(word), '[^a-z0-9''-]', '', 'g'), '''s$', ''), '^[''-]+', ''), '[''-]+$', '')"
TERMS = f", cleaned AS (SELECT doc_id, pos, start_ms, {CLEAN} AS lemma, upper(word[1]) = word[1] AND lower(word[1]) <> word[1] AS proper FROM words), terms AS (SELECT * FROM cleaned WHERE lemma <> '' AND length(lemma) > 1 AND lemma NOT IN ({STOP}) AND regexp_matches(lemma, '^[a-z]'))"
PER_DOC = ", per_doc AS (SELECT lemma, doc_id, count(*) AS n, min(start_ms) AS first_ms, count(*) FILTER (proper) AS caps FROM terms GROUP BY ALL)"


@query(V(f"{TERMS}{PER_DOC} SELECT lemma AS term, 2 * sum(caps) > sum(n) AS proper, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total, min(first_ms) AS first_ms FROM per_doc GROUP BY lemma HAVING count(*) >= 2", "words"))
def term_index(spark, d):
    return index.term_index(A.words(spark, d))


STREAM = f", alpha AS (SELECT doc_id, [w for w in regexp_extract_all(lower(text), '[a-z]+') if length(w) > 1 AND w NOT IN ({STOP})] AS ws FROM documents), stream AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM alpha)"
PAIRS = ", pairs AS (SELECT doc_id, w AS w1, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM stream), counts AS (SELECT w1, w2, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM pairs WHERE w2 IS NOT NULL GROUP BY ALL), singles AS (SELECT w, count(*) AS c FROM stream GROUP BY w), totals AS (SELECT (SELECT sum(c) FROM singles) AS all1, (SELECT sum(n) FROM counts) AS all2), scored AS (SELECT w1 || ' ' || w2 AS term, w1, w2, n::BIGINT AS n, n_docs::BIGINT AS n_docs, round(log2((n / all2) / ((a.c / all1) * (b.c / all1))), 6) AS pmi FROM counts JOIN singles a ON w1 = a.w JOIN singles b ON w2 = b.w, totals)"


@query(f"WITH {STREAM[2:]}{PAIRS} SELECT * FROM scored WHERE pmi >= 3 AND n_docs >= 2")
def bigram_pmi(spark, d):
    return index.bigram_pmi(A.transcripts(spark, d))


ADJACENT = ", adj AS (SELECT doc_id, pos, start_ms, regexp_replace(regexp_replace(regexp_replace(lower(word), '[^a-z0-9''-]', '', 'g'), '^[''-]+', ''), '[''-]+$', '') AS a FROM words), adj2 AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM adj)"


@query(V(f"{STREAM}{PAIRS}{ADJACENT} SELECT a || ' ' || b AS term, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS total, min(start_ms) AS first_ms FROM adj2 WHERE a <> '' AND b <> '' AND a || ' ' || b IN (SELECT term FROM scored WHERE pmi >= 3 AND n_docs >= 2) GROUP BY 1", "words"))
def bigram_entries(spark, d):
    return index.bigram_entries(A.words(spark, d, following=True), index.bigram_pmi(A.transcripts(spark, d)))


@query(V(f", c AS (SELECT doc_id, start_ms, {CLEAN} AS a FROM words) SELECT doc_id, start_ms FROM c WHERE a = 'thing'", "words"))
def term_timecodes(spark, d):
    return index.term_timecodes(A.words(spark, d), "thing")


@query(V("SELECT DISTINCT term FROM (SELECT name AS term FROM concepts UNION ALL SELECT unnest(aliases) FROM concepts) WHERE term IS NOT NULL", "concepts"))
def known_terms(spark, d):
    return index.known_terms(A.concepts(spark, d))


@query(V("SELECT doc_id, pos, word, byte_start, byte_end, start_ms, end_ms FROM words", "words"))
def words_table(spark, d):
    """Transcripts in both encodings, made from the words view, decoded again."""
    w = A.words(spark, d)
    signed = timing.encode_signed(w).withColumn("encoding", F.lit("signed"))
    pairs = timing.encode_pairs(w).select("doc_id", F.lit(0).cast("long").alias("start_ms"), "timings").withColumn("encoding", F.lit("pairs"))
    both = signed.where("doc_id % 2 = 0").unionByName(pairs.where("doc_id % 2 = 1"))
    return timing.words_table(A.transcripts(spark, d).drop("start_ms").join(both, "doc_id"))


GAPS = ", lagged AS (SELECT doc_id, pos, word, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM words)"


@query(V(f"{GAPS} SELECT doc_id, pos, last AS gap_start_ms, start_ms AS gap_end_ms, start_ms - last AS gap_ms FROM lagged WHERE start_ms - last >= 2500", "words"))
def silence_gaps(spark, d):
    return S.silence_gaps(A.words(spark, d), 2500)


@query(V(f"{GAPS}, ctx AS (SELECT doc_id, pos, start_ms - last AS gap_ms, coalesce(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), '') AS before, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS after FROM lagged) SELECT * FROM ctx WHERE gap_ms >= 2500", "words"))
def gap_context(spark, d):
    return S.gap_context(A.listed_words(spark, d), 2500)


@query(V(f"{GAPS}, g AS (SELECT doc_id, pos, last AS gap_start_ms, start_ms AS gap_end_ms, start_ms - last AS gap_ms FROM lagged WHERE start_ms - last >= 2500) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY gap_ms DESC, pos))::INTEGER AS place FROM g QUALIFY place <= 30", "words"))
def top_gaps(spark, d):
    return S.top_gaps(S.silence_gaps(A.words(spark, d), 2500))


@query(V("SELECT doc_id, pos, coalesce((lag(end_ms) OVER o + start_ms) / 2, start_ms)::DOUBLE AS from_ms, coalesce((lead(start_ms) OVER o + end_ms) / 2, end_ms)::DOUBLE AS to_ms FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)", "words"))
def word_boundaries(spark, d):
    return S.word_boundaries(A.words(spark, d))


CHANGES = ", ch AS (SELECT stream, start_s AS at_s, lag(speaker) OVER (PARTITION BY stream ORDER BY start_s, event_id) AS from_speaker, speaker AS to_speaker FROM diarization)"


@query(V(f"{CHANGES} SELECT * FROM ch WHERE from_speaker <> to_speaker", "diarization"))
def speaker_changes(spark, d):
    return S.speaker_changes(A.diarization(spark, d))


@query(V(f"{CHANGES}, g AS (SELECT doc_id::VARCHAR AS stream, lag(end_ms) OVER (PARTITION BY doc_id ORDER BY pos) / 1000 AS a, start_ms / 1000 AS b FROM words) SELECT stream, (a + b) / 2 AS at_s, 1 AS priority FROM g WHERE b - a > 2 UNION ALL SELECT stream, at_s, 2 FROM ch WHERE from_speaker <> to_speaker", "words", "diarization"))
def snap_targets(spark, d):
    w = A.words(spark, d).select(F.col("doc_id").cast("string").alias("stream"), "pos", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return S.snap_targets(w, A.diarization(spark, d))


def blocks_sql(source: str, gap: float, name: str = "blocks") -> str:
    return f""", {name}_turn AS (SELECT *, CASE WHEN lag(speaker) OVER o = speaker THEN 0 ELSE 1 END AS turn FROM {source} WINDOW o AS (PARTITION BY stream ORDER BY start_s, event_id)),
{name}_run AS (SELECT *, sum(turn) OVER (PARTITION BY stream ORDER BY start_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_turn),
{name}_far AS (SELECT *, max(end_s) OVER (PARTITION BY stream, run ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {name}_run),
{name}_isl AS (SELECT *, sum(CASE WHEN start_s < far + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY stream, run ORDER BY start_s, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_far),
{name} AS (SELECT stream, (row_number() OVER (PARTITION BY stream ORDER BY run, isl))::INTEGER AS block, speaker, start_s, end_s FROM (SELECT stream, run, isl, any_value(speaker) AS speaker, min(start_s) AS start_s, max(end_s) AS end_s FROM {name}_isl GROUP BY ALL))"""


@query(V(blocks_sql("diarization", 5.0) + " SELECT * FROM blocks", "diarization"))
def speech_blocks(spark, d):
    return S.speech_blocks(A.diarization(spark, d))


SEGMENTS = """, cuts AS (SELECT *, start_s - lag(end_s) OVER o AS gap, speaker <> lag(speaker) OVER o AS other FROM blocks WINDOW o AS (PARTITION BY stream ORDER BY block)),
seg AS (SELECT *, coalesce(gap > 60 OR (gap >= 30 AND other), false) AS cut FROM cuts),
seg2 AS (SELECT *, (sum(cut::INT) OVER (PARTITION BY stream ORDER BY block ROWS UNBOUNDED PRECEDING))::BIGINT + 1 AS segment FROM seg),
ends AS (SELECT stream, segment, arg_min(start_s, block) AS start_s, arg_max(end_s, block) AS end_s, coalesce(arg_min(CASE WHEN cut THEN gap ELSE 0 END, block), 0)::DOUBLE AS preceding_gap_s FROM seg2 GROUP BY ALL),
times AS (SELECT stream, segment, speaker, sum(end_s - start_s) AS seconds FROM seg2 GROUP BY ALL),
tops AS (SELECT stream, segment, max(seconds) AS top, sum(seconds) AS total, arg_max(speaker, seconds) AS who FROM times GROUP BY ALL)"""


@query(V(blocks_sql("diarization", 5.0) + SEGMENTS + " SELECT stream, segment, start_s, end_s, preceding_gap_s, CASE WHEN top > 0.7 * total THEN who END AS dominant_speaker, CASE WHEN top > 0.7 * total THEN 'single-speaker' ELSE 'panel' END AS kind FROM ends JOIN tops USING (stream, segment)", "diarization"))
def talk_segments(spark, d):
    return S.talk_segments(S.speech_blocks(A.diarization(spark, d)))


@query(V("SELECT stream, speaker, sum(end_s - start_s) AS seconds FROM diarization GROUP BY ALL", "diarization"))
def speaker_durations(spark, d):
    return S.speaker_durations(A.diarization(spark, d), ("stream",))


@query(V(", c AS (SELECT stream, speaker, count(*) AS n, min(event_id) AS f FROM diarization GROUP BY ALL) SELECT stream, speaker, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY stream ORDER BY n DESC, f) = 1", "diarization"))
def dominant_speaker(spark, d):
    return S.dominant_speaker(A.diarization(spark, d))


@query(V("SELECT stream, speaker, count(*)::BIGINT AS segments, round(sum(end_s - start_s) / 60, 6) AS minutes FROM diarization GROUP BY ALL", "diarization"))
def speaker_stats(spark, d):
    return S.speaker_stats(A.diarization(spark, d))


@query(V(", cut AS (SELECT event_id, stream, speaker, greatest(start_s, 2000.0) AS start_s, least(end_s, 9000.0) AS end_s FROM diarization WHERE end_s > 2000 AND start_s < 9000)" + blocks_sql("cut", 1.0) + " SELECT * FROM blocks", "diarization"))
def clip_and_merge(spark, d):
    return S.clip_and_merge(A.diarization(spark, d), 2000.0, 9000.0)


RUNS = ", m AS (SELECT *, length(word) <= 4 AS mem FROM words), n AS (SELECT *, coalesce(NOT lag(mem) OVER o OR start_ms - lag(end_ms) OVER o > 2000, true) AS fresh FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(CASE WHEN mem AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n), z AS (SELECT doc_id, run, min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, count(*) AS c FROM r WHERE mem GROUP BY ALL)"


@query(V(f"{RUNS} SELECT doc_id, start_ms, end_ms, 'short words' AS pattern FROM z WHERE c >= 6", "words"))
def run_zones(spark, d):
    """The zero-run rule on short words, which the test texts have."""
    return S.run_zones(A.words(spark, d), F.length("word") <= 4, 6, 2000, name="short words")


ZEROS = ", zw AS (SELECT * REPLACE (CASE WHEN pos % 97 < 25 THEN '0' ELSE word END AS word) FROM words)"


@query(V(ZEROS + RUNS.replace("FROM words)", "FROM zw)").replace("length(word) <= 4", "trim(word) = '0'").replace("> 2000", "> 5000") + " SELECT doc_id, start_ms, end_ms, 'numeric zero loop' AS pattern FROM z WHERE c >= 20", "words"))
def zero_run_zones(spark, d):
    """A fourth of each hundred words is taken to be a zero."""
    return S.zero_run_zones(A.words(spark, d).withColumn("word", F.when(F.col("pos") % 97 < 25, "0").otherwise(F.col("word"))))


@query(V("""
, g AS (SELECT stream, end_s AS a, lead(start_s) OVER o AS b, row_number() OVER o AS gap FROM diarization WINDOW o AS (PARTITION BY stream ORDER BY start_s, event_id)),
w AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS stream, (pos * 3 + doc_id % 7)::DOUBLE AS start_s, pos * 3 + doc_id % 7 + 1.5::DOUBLE AS end_s FROM words)
SELECT g.stream, min(start_s) AS start_s, arg_max(end_s, start_s) AS end_s, 'diarization silence mismatch' AS pattern FROM g JOIN w ON g.stream = w.stream AND w.start_s >= a AND w.end_s <= b WHERE b - a >= 60 GROUP BY g.stream, gap""", "words", "diarization"))
def silence_mismatch_zones(spark, d):
    """The words of all documents, laid out over the streams."""
    return S.silence_mismatch_zones(A.streamed_words(spark, d, 3.0, 1.5).select("stream", "start_s", "end_s"), A.diarization(spark, d))


LOW = ", b AS (SELECT *, avg_logprob < -1 OR no_speech_prob > 0.5 AS bad FROM asr_segments), c AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY stream ORDER BY start_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b), low AS (SELECT stream, min(start_s) AS start_s, arg_max(end_s, (start_s, event_id)) AS end_s FROM c WHERE bad GROUP BY stream, run HAVING arg_max(end_s, (start_s, event_id)) - min(start_s) > 30)"


@query(V(f"{LOW} SELECT * FROM low", "asr_segments"))
def low_confidence_zones(spark, d):
    return S.low_confidence_zones(A.asr_segments(spark, d))


@query(V(f"{LOW}, f AS (SELECT *, max(end_s) OVER (PARTITION BY stream ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM low), i AS (SELECT *, sum(CASE WHEN start_s <= far + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS isl FROM f) SELECT stream, min(start_s) AS start_s, max(end_s) AS end_s, 'low confidence' AS pattern FROM i GROUP BY stream, isl", "asr_segments"))
def merge_zones(spark, d):
    zones = S.low_confidence_zones(A.asr_segments(spark, d)).withColumn("pattern", F.lit("low confidence"))
    return S.merge_zones(zones, "stream", "start_s", "end_s")


@query(V(", u AS (SELECT doc_id, pos, start_ms, list(lower(word)) OVER o AS ws FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT doc_id, arg_min(start_ms, pos) AS start_ms, min(pos) AS pos FROM u WHERE len(ws) = 20 AND len(list_distinct(ws)) >= 12 GROUP BY doc_id", "words"))
def usable_start(spark, d):
    return S.usable_start(A.words(spark, d))


@query(V("SELECT uri, room, starts_at, coalesce(CASE WHEN uri % 3 = 0 AND uri <> 0 THEN uri END, lead(uri) OVER (PARTITION BY room ORDER BY starts_at, uri)) AS end_key FROM talks", "talks"))
def fill_end_times(spark, d):
    rows = A.talks(spark, d).select("uri", "room", "starts_at", F.when(F.col("uri") % 3 == 0, F.col("uri")).alias("end_key"))
    return S.fill_end_times(rows, "room", "uri", "end_key", ["starts_at", "uri"])


@query(V("SELECT doc_id, (pos // 2000)::INTEGER AS chunk, count(*)::BIGINT AS n, string_agg(word, ' ' ORDER BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY 1, 2", "words"))
def token_chunks(spark, d):
    return S.token_chunks(A.words(spark, d))


@query(V("""
, s AS (SELECT doc_id, start_ms, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms) AS k FROM words),
chain AS (SELECT doc_id, min(start_ms) AS anchor, 0 AS chunk FROM s GROUP BY doc_id UNION ALL
  SELECT c.doc_id, (SELECT min(s.start_ms) FROM s WHERE s.doc_id = c.doc_id AND s.start_ms - c.anchor >= 60000), c.chunk + 1 FROM chain c WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.start_ms - c.anchor >= 60000)),
spans AS (SELECT doc_id, chunk, anchor, lead(anchor) OVER (PARTITION BY doc_id ORDER BY chunk) AS until FROM chain)
SELECT p.doc_id, p.chunk::INTEGER AS chunk, p.anchor AS anchor_ms, count(*)::BIGINT AS n FROM spans p JOIN s ON s.doc_id = p.doc_id AND s.start_ms >= p.anchor AND (p.until IS NULL OR s.start_ms < p.until) GROUP BY ALL""", "words").replace("WITH ", "WITH RECURSIVE ", 1))
def anchored_time_chunks(spark, d):
    return S.anchored_time_chunks(A.words(spark, d), 60_000)


@query(V(", e AS (SELECT doc_id, max(end_ms) AS e FROM words GROUP BY doc_id), spine AS (SELECT doc_id, e, unnest(range(0, (e - 1) // 300000 + 1)) AS bucket FROM e), c AS (SELECT doc_id, start_ms // 300000 AS bucket, count(*) AS n FROM words GROUP BY ALL) SELECT doc_id, bucket, bucket * 300000 AS from_ms, least((bucket + 1) * 300000, e) AS to_ms, coalesce(n, 0)::BIGINT AS n FROM spine LEFT JOIN c USING (doc_id, bucket)", "words"))
def transcript_manifest(spark, d):
    return S.transcript_manifest(A.words(spark, d))


@query(V(", bins AS (SELECT unnest(range(0, 48)) AS bin) SELECT stream, bin, round(sum(greatest(least(end_s, (bin + 1) * 360.0) - greatest(start_s, bin * 360.0), 0)) / 360, 6) AS density FROM diarization JOIN bins ON start_s < (bin + 1) * 360 AND end_s > bin * 360 GROUP BY ALL HAVING density > 0", "diarization"))
def speech_density(spark, d):
    return S.speech_density(A.diarization(spark, d), 17_280.0)


@query(V(", f AS (SELECT *, max(byte_end) OVER (PARTITION BY subject_uri ORDER BY byte_start, uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM comments WHERE byte_start IS NOT NULL), i AS (SELECT *, (sum(CASE WHEN byte_start <= far THEN 0 ELSE 1 END) OVER (PARTITION BY subject_uri ORDER BY byte_start, uri ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM f) SELECT subject_uri, island, min(byte_start) AS byte_start, max(byte_end) AS byte_end, count(*) FILTER (text IN ('👍', '❤'))::BIGINT AS emoji, count(*) FILTER (text NOT IN ('👍', '❤'))::BIGINT AS texts FROM i GROUP BY ALL", "comments"))
def merge_anchored_comments(spark, d):
    return S.merge_anchored_comments(A.comments(spark, d))


@query(V("SELECT event_id, stream, start_s, end_s, greatest(coalesce(lag(end_s) OVER o, 0), 0, least(start_s - 3, end_s - 1)) AS clamped_start_s, coalesce(least(greatest(end_s + 2, start_s + 1), lead(start_s) OVER o), greatest(end_s + 2, start_s + 1)) AS clamped_end_s FROM diarization WINDOW o AS (PARTITION BY stream ORDER BY start_s, event_id)", "diarization"))
def boundary_clamp(spark, d):
    rows = A.diarization(spark, d).withColumns({"new_start_s": F.col("start_s") - 3, "new_end_s": F.col("end_s") + 2})
    return S.boundary_clamp(rows, "stream", S.SPEECH).drop("new_start_s", "new_end_s", "speaker")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_rows(spark, d):
    return S.first_rows(table(spark, d, "documents"), ["text"], ["doc_id"])


@query(V("""
, s AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY vec_id) - 1)::INTEGER AS ordinal, count(*) OVER (PARTITION BY doc) AS n, vector FROM sentence_vectors),
x AS (SELECT doc, ordinal, n, unnest(range(0, len(vector))) AS dim, unnest(vector) AS x FROM s WHERE n >= 6),
m AS (SELECT doc, ordinal, n, avg(x) OVER (PARTITION BY doc, dim ORDER BY ordinal ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, avg(x) OVER (PARTITION BY doc, dim ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b FROM x),
c AS (SELECT doc, ordinal, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS similarity FROM m WHERE ordinal BETWEEN 3 AND n - 3 GROUP BY ALL),
low AS (SELECT * FROM c WHERE similarity < 0.3),
chain AS (SELECT doc, min(ordinal) AS ordinal FROM low GROUP BY doc UNION ALL SELECT k.doc, (SELECT min(l.ordinal) FROM low l WHERE l.doc = k.doc AND l.ordinal >= k.ordinal + 5) FROM chain k WHERE EXISTS (SELECT 1 FROM low l WHERE l.doc = k.doc AND l.ordinal >= k.ordinal + 5))
SELECT doc, ordinal, similarity FROM low JOIN chain USING (doc, ordinal)""", "sentence_vectors").replace("WITH ", "WITH RECURSIVE ", 1))
def topic_breaks(spark, d):
    from pyspark.sql import Window as W

    rows = A.sentence_vectors(spark, d).select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("vec_id")) - 1).alias("ordinal"), "vector")
    return S.topic_breaks(rows)


@query(V(", g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM words) SELECT w.doc_id, t.at_ms, arg_min(w.pos, w.pos) AS pos, arg_min(w.byte_start, w.pos) AS byte_start FROM (SELECT DISTINCT doc_id, unnest([5000, 20000, 60000])::BIGINT AS at_ms FROM words) t JOIN words w ON w.doc_id = t.doc_id AND w.end_ms >= t.at_ms GROUP BY ALL", "words"))
def offset_to_byte(spark, d):
    """The first word that ends at or after an offset."""
    w = A.words(spark, d)
    points = w.select("doc_id").distinct().withColumn("at_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in (5000, 20000, 60000)])))
    return intervals.as_of(points, w.select("doc_id", "end_ms", "pos", "byte_start"), ["doc_id"], "at_ms", "end_ms", forward=True).where("pos is not null").select("doc_id", "at_ms", "pos", "byte_start")


@query(V("SELECT t.doc_id, t.at_ms, max(w.pos) AS pos FROM (SELECT DISTINCT doc_id, unnest([5000, 20000, 60000])::BIGINT AS at_ms FROM words) t JOIN words w ON w.doc_id = t.doc_id AND w.start_ms <= t.at_ms GROUP BY ALL", "words"))
def active_at(spark, d):
    """The last word that started at or before a time."""
    w = A.words(spark, d)
    points = w.select("doc_id").distinct().withColumn("at_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in (5000, 20000, 60000)])))
    return intervals.as_of(points, w.select("doc_id", "start_ms", "pos"), ["doc_id"], "at_ms", "start_ms").where("pos is not null").select("doc_id", "at_ms", "pos")


@query(V("SELECT w.doc_id, w.pos, c.uri FROM words w JOIN comments c ON w.doc_id = c.subject_uri AND w.byte_start < c.byte_end AND w.byte_end > c.byte_start", "words", "comments"))
def overlap_spans(spark, d):
    spans = A.comments(spark, d).where("byte_start is not null").select(F.col("subject_uri").alias("doc_id"), "uri", F.col("byte_start").alias("cs"), F.col("byte_end").alias("ce"))
    return intervals.overlap_join(intervals.of_keys(A.words(spark, d), spans, ["doc_id"]), spans, ["doc_id"], "byte_start", "byte_end", "cs", "ce", 256).select("doc_id", "pos", "uri")


@query(V("SELECT w.doc_id, w.pos, min(c.uri) AS uri FROM words w JOIN comments c ON w.doc_id = c.subject_uri AND w.byte_start >= c.byte_start AND w.byte_end <= c.byte_end GROUP BY ALL", "words", "comments"))
def contained_spans(spark, d):
    spans = A.comments(spark, d).where("byte_start is not null").select(F.col("subject_uri").alias("doc_id"), "uri", F.col("byte_start").alias("cs"), F.col("byte_end").alias("ce"))
    return intervals.containment_join(intervals.of_keys(A.words(spark, d), spans, ["doc_id"]), spans, ["doc_id"], "byte_start", "byte_end", "cs", "ce", 256).groupBy("doc_id", "pos").agg(F.min("uri").alias("uri"))


@query(V(", i AS (SELECT c.subject_uri AS doc_id, c.uri, string_agg(w.word, ' ' ORDER BY w.pos) AS text FROM comments c JOIN words w ON w.doc_id = c.subject_uri AND w.byte_start >= c.byte_start AND w.byte_end <= c.byte_end GROUP BY ALL) SELECT * FROM i", "words", "comments"))
def words_in_window(spark, d):
    spans = A.comments(spark, d).where("byte_start is not null").select(F.col("subject_uri").alias("doc_id"), "uri", F.col("byte_start").alias("cs"), F.col("byte_end").alias("ce"))
    rows = intervals.containment_join(intervals.of_keys(A.words(spark, d), spans, ["doc_id"]), spans, ["doc_id"], "byte_start", "byte_end", "cs", "ce", 256)
    one = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return rows.groupBy("doc_id", "uri").agg(F.array_join(F.transform(one, lambda w: w["word"]), " ").alias("text"))


@query(V("SELECT c.subject_uri AS doc_id, c.text AS kind, min(w.start_ms) AS first_ms FROM comments c JOIN words w ON w.doc_id = c.subject_uri AND w.byte_start < c.byte_end AND w.byte_end > c.byte_start GROUP BY ALL", "words", "comments"))
def first_mention_time(spark, d):
    spans = A.comments(spark, d).where("byte_start is not null").select(F.col("subject_uri").alias("doc_id"), F.col("text").alias("kind"), F.col("byte_start").alias("cs"), F.col("byte_end").alias("ce"))
    return intervals.overlap_join(intervals.of_keys(A.words(spark, d), spans, ["doc_id"]), spans, ["doc_id"], "byte_start", "byte_end", "cs", "ce", 256).groupBy("doc_id", "kind").agg(F.min("start_ms").alias("first_ms"))


@query(V(""", z AS (SELECT doc_id, 1000 * (doc_id % 7) + 2000 AS zs, 1000 * (doc_id % 7) + 6000 AS ze FROM documents UNION ALL SELECT doc_id, 20000, 21500 FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, 1 AS fresh, 0 AS k, unnest(['said', 'anew']) AS word, zs + unnest([100, 600]) AS start_ms, zs + unnest([500, 900]) AS end_ms FROM z),
b AS (SELECT doc_id, 0 AS fresh, pos AS k, word, start_ms, end_ms FROM words w WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = w.doc_id AND w.start_ms < ze AND w.end_ms > zs) UNION ALL SELECT * FROM n)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, fresh, k, end_ms, word) - 1)::INTEGER AS pos, word, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms FROM b""", "words"))
def replace_in_zones(spark, d):
    """Two zones at fixed times; two words are put in each."""
    docs = table(spark, d, "documents").select("doc_id")
    zone = lambda rows, at, to: rows.select("doc_id", at.cast("long").alias("start_ms"), to.cast("long").alias("end_ms"))
    first = 1000 * (F.col("doc_id") % 7)
    zones = zone(docs, first + 2000, first + 6000).union(zone(docs.where("doc_id % 2 = 0"), F.lit(20_000), F.lit(21_500)))
    said = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), (F.col("start_ms") + a).alias("start_ms"), (F.col("start_ms") + b).alias("end_ms")) for w, a, b in (("said", 100, 500), ("anew", 600, 900))]))
    return S.replace_in_zones(A.words(spark, d), zones, zones.select("doc_id", said.alias("w")).select("doc_id", "w.*"))
