"""Queries on segments matched to talks. Words carry scripted introductions; codes are upper-case names, so that SQL has them too."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import matching as M
from spanloom.operators import sequence as S
from spanloom.sources.files import written

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query
from .timed import SEGMENTS, blocks_sql

NAMES = ["Ada", "Grace", "Alan", "Edsger", "Barbara", "Donald", "Ida", "Tony"]
SCRIPT = ["my", "name", "is", 0, "I'm", 1, "please", "welcome", 2, "next", "up", "is", 3]
AT = 10


def words(spark, d):
    """Documents on the streams of their days, three seconds a word; every third one has introductions."""
    doc, pos = F.floor(F.col("pos") / 100_000), F.col("pos") % 100_000
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), ((doc + F.floor(pos / 50) + k) % len(NAMES) + 1).cast("int"))
    script = F.array(*[name(s) if isinstance(s, int) else F.lit(s) for s in SCRIPT])
    at = (pos % 50 - AT + 1).cast("int")
    said = F.when((doc % 3 == 0) & at.between(1, len(SCRIPT)), F.try_element_at(script, F.when(at > 0, at).otherwise(1))).otherwise(F.col("word"))
    return A.streamed_words(spark, d, 3.0, 1.5).withColumn("word", said)


def talks(spark, d):
    """A talk for each document: some of its words as title, two speakers."""
    i = F.col("doc_id")
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (i % 30).cast("int")), "yyyy-MM-dd")
    from spanloom.functions.text import tokenize_ws

    title = F.array_join(F.slice(tokenize_ws(F.coalesce("text", F.lit(""))), 21, 6), " ")
    return table(spark, d, "documents").select(day.alias("stream"), i.alias("talk"), title.alias("title"), F.array(F.concat_ws(" ", name(i), F.lit("Li")), name(F.floor(i / 8))).alias("speakers"), (F.floor(i / 30) * 500.0).alias("starts_s"))


def segments(spark, d):
    return written(S.talk_segments(S.speech_blocks(A.diarization(spark, d))), "segments")


_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_SCRIPT = "[" + ", ".join(f"{_NAMES}[(doc_id + pos // 50 + {s}) % {len(NAMES)} + 1]" if isinstance(s, int) else "'" + s.replace("'", "''") + "'" for s in SCRIPT) + "]"
WORDS = f", w AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS stream, doc_id * 100000 + pos AS pos, CASE WHEN doc_id % 3 = 0 AND pos % 50 BETWEEN {AT} AND {AT + len(SCRIPT) - 1} THEN {_SCRIPT}[pos % 50 - {AT - 1}] ELSE word END AS word, pos * 3.0::DOUBLE + doc_id % 7 AS start_s, pos * 3.0::DOUBLE + doc_id % 7 + 1.5 AS end_s FROM words)"
TALKS = f", t AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS stream, doc_id AS talk, array_to_string(ws[21:26], ' ') AS title, [{_NAMES}[doc_id % 8 + 1], {_NAMES}[doc_id // 8 % 8 + 1]] AS parts, (doc_id // 30 * 500.0)::DOUBLE AS starts_s FROM token_lists)"
SEGS = ", sgm AS (SELECT stream, segment, start_s, end_s, top <= 0.7 * total AS panel FROM ends JOIN tops USING (stream, segment))"
_NO = "(" + ", ".join(f"'{n}'" for n in M.NO_NAMES) + ")"
_STOP = "(" + ", ".join(f"'{n}'" for n in M.TITLE_STOPWORDS) + ")"
SIGNALS = f"""
, win AS (SELECT stream, segment, 'intro' AS k, start_s AS f, least(start_s + 120, end_s) AS u FROM sgm UNION ALL SELECT stream, segment, 'before', greatest(0, start_s - 60), start_s FROM sgm),
heard AS (SELECT win.stream, segment, k, pos, word FROM win JOIN w ON w.stream = win.stream AND w.start_s >= f AND w.end_s <= u),
texts AS (SELECT stream, segment, k, string_agg(word, ' ' ORDER BY pos) AS text FROM heard GROUP BY ALL),
said AS (
  SELECT DISTINCT * FROM (SELECT stream, segment, 'self-intro' AS source, unnest(regexp_extract_all(text, '\\bmy name(?:''s| is)\\s+([A-Z][a-z]+)', 1) || regexp_extract_all(text, '\\bI''m\\s+([A-Z][a-z]+)', 1)) AS name FROM texts WHERE k = 'intro') WHERE name NOT IN {_NO}
  UNION ALL SELECT DISTINCT stream, segment, 'mc-handoff', unnest(regexp_extract_all(text, '(?i)\\bplease welcome\\s+([A-Z][a-z]+)', 1) || regexp_extract_all(text, '(?i)\\bnext up (?:is|we have)\\s+([A-Z][a-z]+)', 1)) FROM texts WHERE k = 'before'
  UNION ALL SELECT stream, segment, 'mc-handoff', '' FROM texts WHERE k = 'before' AND regexp_matches(text, '(?i)\\bsetting up next\\b')
  UNION ALL SELECT DISTINCT stream, segment, 'topic', unnest([x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+') IF length(x) >= 4]) FROM texts WHERE k = 'intro'),
parts AS (SELECT DISTINCT stream, talk, unnest(parts) AS part FROM t),
toks AS (SELECT DISTINCT stream, segment, regexp_replace(lower(word), '[^a-z''-]', '', 'g') AS token FROM heard),
scan AS (SELECT DISTINCT toks.stream, segment, 'name-scan' AS source, part AS name FROM toks JOIN (SELECT DISTINCT stream, part FROM parts) p ON p.stream = toks.stream AND length(token) >= 3
  AND (left(upper(token), 3) = left(upper(part), 3) OR (regexp_matches(upper(token), '^[AEIOU]') AND regexp_matches(upper(part), '^[AEIOU]') AND substr(upper(token), 2) = substr(upper(part), 2)))),
sig AS (SELECT * FROM said UNION ALL SELECT * FROM scan WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.stream = scan.stream AND said.segment = scan.segment AND said.source <> 'topic' AND lower(said.name) = lower(scan.name)))"""


def chain(sql: str) -> str:
    return V(blocks_sql("diarization", 5.0) + SEGMENTS + SEGS + WORDS + TALKS + SIGNALS + sql, "words", "diarization")


@query(chain(" SELECT stream, segment, source, name FROM sig"))
def segment_signals(spark, d):
    return M.segment_signals(words(spark, d), segments(spark, d), talks(spark, d), F.upper)


MATCHES = f"""
, named AS (SELECT DISTINCT sig.stream, segment, talk, source FROM sig JOIN parts ON parts.stream = sig.stream AND sig.source <> 'topic' AND length(sig.name) >= 3 AND left(upper(sig.name), 3) = left(upper(part), 3)),
n AS (SELECT stream, segment, talk, list(source) AS src FROM named GROUP BY ALL),
kw AS (SELECT stream, talk, unnest([x FOR x IN regexp_split_to_array(lower(regexp_replace(title, '[^\\w\\s]', ' ', 'g')), '\\s+') IF length(x) >= 4 AND x NOT IN {_STOP}]) AS name FROM t),
tp AS (SELECT sig.stream, segment, talk, count(*) AS topics FROM sig JOIN kw ON kw.stream = sig.stream AND kw.name = sig.name WHERE source = 'topic' GROUP BY ALL),
pairs AS (SELECT stream, segment, talk, coalesce(src, []) AS src, coalesce(topics, 0) AS topics FROM n FULL JOIN tp USING (stream, segment, talk)),
j AS (SELECT pairs.*, sgm.start_s, sgm.end_s, panel, starts_s, abs(sgm.start_s - (starts_s - min_t + min_s)) AS off FROM pairs JOIN sgm USING (stream, segment) JOIN t USING (stream, talk)
  JOIN (SELECT stream, min(starts_s) AS min_t FROM t GROUP BY stream) USING (stream) JOIN (SELECT stream, min(start_s) AS min_s FROM sgm GROUP BY stream) USING (stream)),
s AS (SELECT *, off <= 600 AS near, CASE WHEN list_contains(src, 'self-intro') THEN 'self-intro' WHEN panel AND list_contains(src, 'name-scan') THEN 'name-scan' WHEN list_contains(src, 'mc-handoff') THEN 'mc-handoff' WHEN list_contains(src, 'name-scan') THEN 'name-scan' END AS source FROM j),
sc AS (SELECT *, (CASE source WHEN 'self-intro' THEN 3.0 WHEN 'name-scan' THEN 2.5 WHEN 'mc-handoff' THEN 2.0 ELSE 0.0 END)::DOUBLE + least(topics, 2) + CASE WHEN near THEN greatest(1.5::DOUBLE - off / 600, 0) ELSE 0 END AS score,
  CASE WHEN source IS NOT NULL AND (topics >= 2 OR (near AND topics >= 1)) THEN 'high' WHEN source IN ('self-intro', 'name-scan') OR topics >= 2 OR (near AND (source IS NOT NULL OR topics >= 1)) THEN 'medium' ELSE 'low' END AS confidence FROM s
  WHERE source IS NOT NULL OR topics >= 2 OR (panel AND near AND topics >= 1)),
m AS (SELECT * FROM sc QUALIFY panel OR row_number() OVER (PARTITION BY stream, segment, panel ORDER BY score DESC, starts_s, talk) = 1)"""


@query(chain(MATCHES + " SELECT stream, segment, talk, start_s, end_s, confidence, round(score, 6) AS score, panel FROM m"))
def match_segments(spark, d):
    g, t = segments(spark, d), talks(spark, d)
    rows = M.match_segments(written(M.segment_signals(words(spark, d), g, t, F.upper), "signals"), g, t, F.upper)
    return rows.withColumn("score", F.round("score", 6))


@query()
def match_leftovers(spark, d):
    g, t = segments(spark, d), talks(spark, d)
    signals = written(M.segment_signals(words(spark, d), g, t, F.upper), "signals")
    rows = M.match_leftovers(signals, g, t, written(M.match_segments(signals, g, t, F.upper), "matches"), F.upper)
    return rows.withColumn("score", F.round("score", 6))


RECONCILE = """
, raw AS (SELECT sgm.stream, sgm.segment, t.talk, sgm.start_s, CASE (sgm.segment + talk) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, (sgm.segment + talk) % 3 AS bad FROM sgm JOIN t ON t.stream = sgm.stream AND sgm.segment % 7 = talk // 30 % 7 AND talk % 4 <> 0),
b AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY stream, talk ORDER BY bad, start_s) = 1),
z AS (SELECT stream, segment * 400.0 AS zs, segment * 400.0 + 150 AS ze FROM sgm WHERE segment % 5 = 0),
len AS (SELECT stream, max(start_s) + 20 AS duration_s FROM sgm GROUP BY stream),
nx AS (SELECT *, lead(start_s) OVER (PARTITION BY stream ORDER BY start_s, talk) AS n FROM b),
es AS (SELECT nx.*, (SELECT arg_max(sgm.end_s, sgm.start_s) FROM sgm WHERE sgm.stream = nx.stream AND sgm.start_s <= nx.start_s + 1) AS e FROM nx),
rest AS (SELECT t.*, EXISTS (SELECT 1 FROM z WHERE z.stream = t.stream AND starts_s BETWEEN zs AND ze) AS inz FROM t ANTI JOIN b ON b.stream = t.stream AND b.talk = t.talk)
SELECT stream, 'matched' AS status, talk, NULL::BIGINT AS segment, start_s, CASE WHEN n IS NULL THEN least(duration_s, e) WHEN n - start_s <= 60 THEN n ELSE e END AS end_s, confidence FROM es JOIN len USING (stream)
UNION ALL SELECT stream, CASE WHEN inz THEN 'unverifiable' ELSE 'open talk' END, talk, NULL, CASE WHEN inz THEN 0.0 END, NULL, CASE WHEN inz THEN 'unverifiable' END FROM rest
UNION ALL SELECT stream, 'open segment', NULL, segment, start_s, end_s, NULL FROM sgm WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.stream = sgm.stream AND b.start_s BETWEEN sgm.start_s - 5 AND sgm.end_s + 5)"""


@query(V(blocks_sql("diarization", 5.0) + SEGMENTS + SEGS + TALKS + RECONCILE, "words", "diarization"))
def reconcile(spark, d):
    """Matches dealt to talks by number; a zone after each fifth segment."""
    g, t = segments(spark, d), talks(spark, d)
    i = F.col("segment") + F.col("talk")
    rows = g.join(t.withColumn("_k", F.floor(F.col("talk") / 30) % 7).where("talk % 4 <> 0"), (g.stream == t.stream) & (g.segment % 7 == F.col("_k"))).select(
        g.stream, "segment", "talk", "start_s", "end_s", F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("low").alias("confidence")
    )
    zones = g.where("segment % 5 = 0").select("stream", (F.col("segment") * 400.0).alias("start_s"), (F.col("segment") * 400.0 + 150).alias("end_s"))
    return M.reconcile(rows, g, t, zones, g.groupBy("stream").agg((F.max("start_s") + 20).alias("duration_s")))


@query()
def detect_boundaries(spark, d):
    di = A.diarization(spark, d)
    return M.detect_boundaries(words(spark, d), di, talks(spark, d), di.groupBy("stream").agg(F.max("end_s").alias("duration_s")), F.upper)
