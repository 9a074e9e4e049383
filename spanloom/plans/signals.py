"""Queries on scored gaps, merged garbage zones and sound codes. Each document is a stream of its own, its times
stretched by 1000 / 64, so that seconds are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import phonetic_code as code_of
from spanloom.operators import boundaries as B
from spanloom.operators import spans as P

from . import adapters as A
from .adapters import with_views as V
from .detection import _phrases
from .registry import query
from .timed import RUNS


def word(w):
    """A listed word as (pos, word, start_s, end_s, speaker): three speakers take turns of some sixty words; some words have none."""
    pos = w["pos"]
    turn = (F.floor(pos / (40 + F.col("stream") % 5 * 10)) + F.col("stream")) % 3 + 1
    speaker = F.when(pos % 10 != 7, F.element_at(F.array(*map(F.lit, ("ann", "bo", "cy"))), F.when(pos % 17 == 0, 1).otherwise(turn).cast("int")))
    return F.struct(pos.alias("pos"), w["word"].alias("word"), (w["start_ms"] / 64).alias("start_s"), (w["end_ms"] / 64).alias("end_s"), speaker.alias("speaker"))


def asr(rows):
    """Each eleventh word as a recognized segment of more or less confidence."""
    pos = F.col("w.pos")
    each = rows.select("stream", F.explode(F.filter("ws", lambda w: w["pos"] % 11 == 0)).alias("w"))
    return each.select("stream", (F.col("w.start_ms") / 64).alias("start_s"), (F.col("w.end_ms") / 64).alias("end_s"), (-(pos % 5) / 2).alias("avg_logprob"), ((pos + 3) % 10 / 10).alias("no_speech_prob"))


def _most(speakers: str) -> str:
    """The most frequent speaker of a list in SQL; the first seen wins ties."""
    each = f"{{'n': len(list_filter({speakers}, lambda y: y = x)), 'i': -list_position({speakers}, x), 's': x}}"
    return f"list_sort(list_transform({speakers}, lambda x: {each}))[-1].s"


GAP_SCORES = f"""
, w AS (SELECT doc_id AS stream, pos, word, start_ms / 64.0::DOUBLE AS start_s, end_ms / 64.0::DOUBLE AS end_s, CASE WHEN pos % 10 <> 7 THEN (['ann', 'bo', 'cy'])[CASE WHEN pos % 17 = 0 THEN 1 ELSE (pos // (40 + doc_id % 5 * 10) + doc_id) % 3 + 1 END] END AS speaker FROM words),
asr AS (SELECT stream, start_s, end_s, -(pos % 5) / 2 AS logprob, (pos + 3) % 10 / 10 AS silent FROM w WHERE pos % 11 = 0),
l AS (SELECT stream, start_s AS at_s, start_s - lag(end_s) OVER o AS gap_s, list(word) OVER b AS wb, list(word) OVER a AS wa, list(speaker) OVER b AS sb0, list(speaker) OVER a AS sa0 FROM w
  WINDOW o AS (PARTITION BY stream ORDER BY pos), b AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
g AS (SELECT stream, at_s, gap_s, array_to_string(wb, ' ') AS before, array_to_string(wa, ' ') AS after, list_filter(sb0, lambda x: x IS NOT NULL) AS sb, list_filter(sa0, lambda x: x IS NOT NULL) AS sa FROM l WHERE gap_s >= 3),
c AS (SELECT *, len(list_distinct(list_intersect(sb, sa))) AS common, least(len(list_distinct(sb)), len(list_distinct(sa))) AS fewer, {_most("sb")} AS mb, {_most("sa")} AS ma FROM g),
s AS (SELECT *, CASE WHEN len(sb) = 0 OR len(sa) = 0 THEN 0 WHEN mb <> ma THEN CASE WHEN common = 0 THEN 15 ELSE 12 END WHEN common < fewer * 0.5 THEN 8 ELSE 0 END AS change FROM c),
p AS (SELECT g.stream, at_s, least(10, 3 * count(*) FILTER (logprob < -1)) + least(8, 2 * count(*) FILTER (silent > 0.5)) AS penalty FROM g JOIN asr x ON x.stream = g.stream AND x.start_s >= at_s - 30 AND x.end_s <= at_s + 30 GROUP BY ALL)
SELECT s.stream, s.at_s, gap_s, (CASE WHEN gap_s >= 60 THEN 25.0 WHEN gap_s >= 30 THEN 15 + (gap_s - 30) / 3 ELSE least(15.0, gap_s * 0.5) END{_phrases("before", B.PHRASES_BEFORE)}{_phrases("after", B.PHRASES_AFTER)} + change - coalesce(penalty, 0))::DOUBLE AS score, before, after
FROM s LEFT JOIN p ON p.stream = s.stream AND p.at_s = s.at_s"""


@query(V(GAP_SCORES, "words"))
def score_gaps(spark, d):
    rows = A.listed_words(spark, d).withColumnRenamed("doc_id", "stream")
    return B.score_gaps(rows, asr(rows), each=word)


ZONES = (
    """
, said AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 AND pos % 97 < 25 THEN '0' WHEN doc_id % 2 = 0 AND pos % 50 < 4 THEN (['thank', 'you', 'for', 'watching'])[pos % 50 + 1] ELSE word END AS word, start_ms / 64.0::DOUBLE AS start_s, end_ms / 64.0::DOUBLE AS end_s FROM words),
ms AS (SELECT doc_id, pos, word, floor(start_s * 1000)::BIGINT AS start_ms, floor(end_s * 1000)::BIGINT AS end_ms FROM said),
h AS (SELECT doc_id, start_ms, last(end_ms) OVER o AS end_ms, array_to_string(list(word) OVER o, ' ') AS phrase FROM ms WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"""
    + RUNS.replace("FROM words)", "FROM ms)").replace("length(word) <= 4", "trim(word) = '0'").replace("> 2000", "> 5000")
    + """
, d AS (SELECT doc_id, pos, start_s AS a0, start_s + CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 300 END AS a, lead(start_s) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM said WHERE pos % 50 = 0),
found AS (
  SELECT doc_id AS stream, min(start_ms) / 1000 AS start_s, max(end_ms) / 1000 AS end_s, 'Thank you for watching' AS pattern FROM h WHERE regexp_matches(phrase, '(?i)thank\\s+you\\s+for\\s+watching') GROUP BY 1 HAVING count(*) >= 3
  UNION ALL SELECT doc_id, start_ms / 1000, end_ms / 1000, 'numeric zero loop' FROM z WHERE c >= 20
  UNION ALL SELECT d.doc_id, min(s.start_s), arg_max(s.end_s, s.start_s), 'diarization silence mismatch' FROM d JOIN said s ON s.doc_id = d.doc_id AND s.start_s >= a AND s.end_s <= b WHERE b - a >= 60 GROUP BY d.doc_id, d.pos),
f AS (SELECT *, max(end_s) OVER (PARTITION BY stream ORDER BY start_s, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM found),
i AS (SELECT *, sum(CASE WHEN start_s <= far + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY start_s, pattern ROWS UNBOUNDED PRECEDING) AS isl FROM f),
each AS (SELECT stream, isl, pattern, min(start_s) AS start_s, max(end_s) AS end_s FROM i GROUP BY ALL)
SELECT stream, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(pattern, '; ' ORDER BY start_s, pattern) AS pattern FROM each GROUP BY stream, isl"""
)


@query(V(ZONES, "words"))
def hallucination_zones(spark, d):
    """Every second document repeats a phrase, every third has runs of zeros, every fifth is silent between segments."""
    thanks = F.element_at(F.array(*map(F.lit, ("thank", "you", "for", "watching"))), F.least(F.col("pos") % 50 + 1, F.lit(4)).cast("int"))
    said = F.when((F.col("doc_id") % 3 == 0) & (F.col("pos") % 97 < 25), "0").when((F.col("doc_id") % 2 == 0) & (F.col("pos") % 50 < 4), thanks).otherwise(F.col("word"))
    rows = A.words(spark, d).select(F.col("doc_id").alias("stream"), "pos", said.alias("word"), (F.col("start_ms") / 64).alias("start_s"), (F.col("end_ms") / 64).alias("end_s"))
    end = F.col("start_s") + F.when(F.col("stream") % 5 == 0, 20).otherwise(300)
    segments = rows.where("pos % 50 = 0").select("stream", F.col("pos").alias("event_id"), "start_s", end.alias("end_s"))
    return P.zones_of(rows, segments)


def _at(k: str) -> str:
    return f"substr(w, {k}, 1)"


#: The sound code of ``w`` (lower-case letters) in SQL: the sound of each letter in its surroundings, then one fold.
_C, _P, _N, _M = _at("i"), _at("i - 1"), _at("i + 1"), _at("i + 2")
_SOFT, _OPEN = "('e', 'i', 'y', '')", "('a', 'o', '')"
_VOWELS = "('a', 'e', 'i', 'o', 'u')"


def _joined(at: str, after: str, beyond: str) -> str:
    """Whether two letters make one sound."""
    return f"({at} || {after} IN ('ch', 'sh', 'th') OR ({at} || {after} = 'dg' AND {beyond} IN {_SOFT}) OR ({at} || {after} IN ('si', 'ti') AND {beyond} IN {_OPEN}) OR ({at} || {after} = 'gh' AND {beyond} <> '' AND {beyond} NOT IN {_VOWELS}))"


_SOUND = f"""CASE WHEN i > 2 AND {_joined(_P, _C, _N)} THEN '' WHEN {_C} IN {_VOWELS} THEN ''
 WHEN {_C} || {_N} IN ('ch', 'sh') THEN 'X' WHEN {_C} || {_N} = 'th' THEN '0' WHEN {_C} || {_N} = 'dg' AND {_M} IN {_SOFT} THEN 'J' WHEN {_C} || {_N} IN ('si', 'ti') AND {_M} IN {_OPEN} THEN 'X'
 WHEN {_C} || {_N} = 'gh' AND {_M} <> '' AND {_M} NOT IN {_VOWELS} THEN ''
 WHEN {_C} = 'b' THEN CASE WHEN {_P} = 'm' AND {_N} = '' THEN '' ELSE 'B' END
 WHEN {_C} = 'c' THEN CASE WHEN {_N} IN {_SOFT} THEN 'S' ELSE 'K' END
 WHEN {_C} = 'g' THEN CASE WHEN {_N} IN {_SOFT} THEN 'J' ELSE 'K' END
 WHEN {_C} = 'h' THEN CASE WHEN {_P} IN {_VOWELS} THEN '' ELSE 'H' END
 WHEN {_C} = 'k' THEN CASE WHEN {_P} = 'c' OR substr(w, i - 2, 2) = 'ch' AND i > 2 THEN '' ELSE 'K' END
 WHEN {_C} = 'p' THEN CASE WHEN {_N} = 'h' THEN 'F' ELSE 'P' END
 WHEN {_C} IN ('w', 'y') THEN CASE WHEN {_N} IN {_VOWELS} THEN upper({_C}) ELSE '' END
 WHEN {_C} = 'd' THEN 'T' WHEN {_C} = 'q' THEN 'K' WHEN {_C} = 'v' THEN 'F' WHEN {_C} = 'x' THEN 'KS' WHEN {_C} = 'z' THEN 'S' ELSE upper({_C}) END"""


def codes_sql(source: str, token: str, name: str) -> str:
    """CTEs that end in ``name``: (token, code) of the distinct tokens of a relation."""
    return f""", {name}_0 AS (SELECT DISTINCT {token} AS token, regexp_replace(lower({token}), '[^a-z]', '', 'g') AS r FROM {source}),
{name}_1 AS (SELECT token, CASE WHEN substr(r, 1, 2) IN ('kn', 'gn', 'pn', 'wr', 'ae') THEN substr(r, 2) WHEN substr(r, 1, 2) = 'wh' THEN 'w' || substr(r, 3) WHEN r[1] = 'x' THEN 's' || substr(r, 2) ELSE r END AS w FROM {name}_0),
{name}_2 AS (SELECT token, w, unnest(range(2, greatest(length(w), 1) + 2)) AS i FROM {name}_1),
{name}_3 AS (SELECT token, w, list({_SOUND} ORDER BY i) AS sounds FROM {name}_2 GROUP BY token, w),
{name} AS (SELECT token, CASE WHEN w = '' THEN '' ELSE list_reduce([upper(w[1])] || sounds, lambda a, s: CASE WHEN s = '' OR s = right(a, 1) OR length(a) >= 6 THEN a ELSE a || s END)[1:6] END AS code FROM {name}_3)"""


@query(V(codes_sql("word_rows", "word", "codes") + " SELECT token AS word, code FROM codes", "word_rows"))
def phonetic_code(spark, d):
    """Sound codes of the distinct words."""
    return A.words(spark, d).select("word").distinct().select("word", F.pandas_udf(lambda w: code_of(w), "string")("word").alias("code"))


NAMES_HEARD = (
    ", parts AS (SELECT DISTINCT uri AS name_id, unnest(regexp_split_to_array(lower(name), '\\s+')) AS part FROM concepts), said AS (SELECT DISTINCT regexp_replace(lower(word), '[^a-z''-]', '', 'g') AS word FROM word_rows)"
    + codes_sql("parts", "part", "pc")
    + codes_sql("said", "word", "wc")
    + """
, a AS (SELECT token AS part, code AS ca FROM pc WHERE length(token) >= 3 AND length(code) >= 2), b AS (SELECT token AS word, code AS cb FROM wc WHERE length(token) >= 3 AND code <> ''),
pairs AS (SELECT part, word FROM a JOIN b ON ca = cb
  UNION SELECT part, word FROM a JOIN b ON ca[1:3] = cb[1:3] AND length(ca) >= 3 AND length(cb) >= 3
  UNION SELECT part, word FROM a JOIN b ON ca[2:] = cb[2:] AND regexp_matches(ca, '^[AEIOU]') AND regexp_matches(cb, '^[AEIOU]') AND length(cb) >= 2)
SELECT DISTINCT name_id, word FROM parts JOIN pairs USING (part)"""
)


@query(V(NAMES_HEARD, "concepts", "word_rows"))
def phonetic_name_join(spark, d):
    return B.phonetic_name_join(A.concepts(spark, d).select(F.col("uri").alias("name_id"), "name"), A.heard_words(spark, d))
