"""Queries on gaps matched to talks. Each document is a stream of its own, stretched twentyfold; every third has
introductions. Codes of names are upper-case names, so that SQL has them too."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import tokenize_ws
from spanloom.operators import boundaries as B
from spanloom.operators import sequence as S
from spanloom.operators import transitions as T
from spanloom.sources.files import written

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .detection import _phrases
from .matching import AT, NAMES, _NAMES
from .registry import query

SCRIPT = ["thank", "you", "all", "hello", "everyone", "my", "name", "is", 0, "and", "i'm", "going", "to", "talk", "so", "today"]
PLACES, WITHIN = 8, 3000.0


def words(spark, d):
    """(stream, ws): the words of each document in order."""

    def said(w):
        doc, pos = F.col("doc_id"), w["pos"]
        name = F.element_at(F.array(*map(F.lit, NAMES)), ((doc + F.floor(pos / 50)) % len(NAMES) + 1).cast("int"))
        at = (pos % 50 - AT + 1).cast("int")
        return F.when((doc % 3 == 0) & at.between(1, len(SCRIPT)), F.try_element_at(F.array(*[name if s == 0 else F.lit(s) for s in SCRIPT]), F.when(at > 0, at).otherwise(1))).otherwise(w["word"])

    each = lambda w: F.struct(w["pos"].alias("pos"), said(w).alias("word"), (w["start_ms"] / 50).alias("start_s"), (w["end_ms"] / 50).alias("end_s"))
    return A.listed_words(spark, d).select(F.col("doc_id").alias("stream"), F.transform("ws", each).alias("ws"))


def talks(spark, d):
    """Eight talks a document: six of its words as title, a speaker each."""
    doc = F.col("doc_id")
    ws = table(spark, d, "documents").select(doc, tokenize_ws(F.coalesce("text", F.lit(""))).alias("ws"), F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("place"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), ((doc + F.col("place")) % len(NAMES) + 1).cast("int"))
    return ws.select(doc.alias("stream"), "place", (doc * 100 + F.col("place")).alias("talk"), F.array_join(F.slice("ws", 40 * F.col("place") + 5, 6), " ").alias("title"), F.array(F.concat_ws(" ", name, F.lit("Li"))).alias("speakers"), (300.0 + 100 * F.col("place")).alias("duration_s"), F.lit(100.0).alias("first_s"))


def gaps(spark, d):
    """(stream, at_s, before, after, score) of pauses, scored by length and phrases."""
    rows = S.with_context(words(spark, d), "start_s", "end_s", 3.0, 20, 30, "stream", ["start_s"])
    rows = rows.select("stream", F.col("start_s").alias("at_s"), "gap", F.col("past.word").alias("before"), F.col("ahead.word").alias("after"))
    return rows.withColumn("score", B.transition_score(F.col("gap"), F.array_join("before", " "), F.array_join("after", " ")))


_SCRIPT = "[" + ", ".join(f"{_NAMES}[(doc_id + pos // 50) % {len(NAMES)} + 1]" if s == 0 else "'" + s.replace("'", "''") + "'" for s in SCRIPT) + "]"
WORDS = f", w AS (SELECT doc_id AS stream, pos, CASE WHEN doc_id % 3 = 0 AND pos % 50 BETWEEN {AT} AND {AT + len(SCRIPT) - 1} THEN {_SCRIPT}[pos % 50 - {AT - 1}] ELSE word END AS word, start_ms / 50.0::DOUBLE AS start_s, end_ms / 50.0::DOUBLE AS end_s FROM words)"
TALKS = f""", tk AS (SELECT doc_id AS stream, place, doc_id * 100 + place AS talk, array_to_string(ws[40 * place + 5:40 * place + 10], ' ') AS title, {_NAMES}[(doc_id + place) % {len(NAMES)} + 1] AS speaker, (300 + 100 * place)::DOUBLE AS duration_s FROM (SELECT doc_id, coalesce(ws, []) AS ws, unnest(range(0, {PLACES})) AS place FROM token_lists)),
t AS (SELECT *, 100.0::DOUBLE + coalesce(sum(duration_s + CASE WHEN duration_s <= 600 THEN 60 ELSE 180 END) OVER (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due_s, lag(duration_s) OVER (PARTITION BY stream ORDER BY place) AS d FROM tk)"""
GAPS = f""", wl AS (SELECT stream, start_s AS at_s, start_s - lag(end_s) OVER o AS gap, coalesce(list(word) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS b, list(word) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS a FROM w WINDOW o AS (PARTITION BY stream ORDER BY pos)),
gc AS (SELECT stream, at_s, gap, array_to_string(b, ' ') AS before, array_to_string(a, ' ') AS after, b || a AS ws FROM wl WHERE gap >= 3),
g AS (SELECT *, CASE WHEN gap >= 60 THEN 25.0 WHEN gap >= 30 THEN 15 + (gap - 30) / 3 ELSE least(15.0, gap * 0.5) END::DOUBLE{_phrases('before', B.PHRASES_BEFORE)}{_phrases('after', B.PHRASES_AFTER)} AS score FROM gc)"""
_COMMON = "(" + ", ".join(f"'{w}'" for w in T.COMMON_TITLE_WORDS) + ")"


def heard(words_sql: str, part: str) -> str:
    """Whether a word of a list sounds like a name, by upper-case codes."""
    v = "AEIOU"
    said = f"regexp_replace(lower(x), '[^a-z''-]', '', 'g')"
    return f"len([1 FOR x IN {words_sql} IF length({said}) >= 3 AND (left({said}, 3) = left(lower({part}), 3) OR (regexp_matches(upper({said}), '^[{v}]') AND regexp_matches(upper({part}), '^[{v}]') AND substr({said}, 2) = substr(lower({part}), 2)))]) > 0"


PAIRS = f""", pr AS (SELECT t.stream, talk, at_s, CASE WHEN {heard('ws', 'speaker')} THEN 10 ELSE 0 END AS named,
  len([1 FOR x IN regexp_split_to_array(lower(title), '\\s+') IF length(x) > 4 AND x NOT IN {_COMMON} AND contains(lower(before || ' ' || after), x)]) AS n
  FROM t JOIN g ON g.stream = t.stream AND abs(at_s - due_s) <= {WITHIN}),
bonus AS (SELECT stream, talk, at_s, (named + CASE WHEN n >= 2 THEN 3 * n ELSE 0 END)::BIGINT AS bonus FROM pr WHERE named > 0 OR n >= 2)"""


def sql(tail: str, recursive: bool = False) -> str:
    out = V(WORDS + TALKS + GAPS + PAIRS + tail, "words")
    return out.replace("WITH", "WITH RECURSIVE", 1) if recursive else out


@query(sql(" SELECT * FROM bonus"))
def score_gap_talk_pairs(spark, d):
    return T.score_gap_talk_pairs(gaps(spark, d), T.planned_starts(talks(spark, d)), WITHIN, F.upper)


ASSIGN = """, chain AS (
  SELECT stream, place, talk, due_s AS at_s, 0.0::DOUBLE AS score, 0.0::DOUBLE AS drift FROM t WHERE place = 0
  UNION ALL SELECT c.stream, n.place, n.talk, coalesce(n.hit.at, n.expected), coalesce(n.hit.value, 0), CASE WHEN n.hit IS NULL THEN n.drift ELSE n.drift + 0.5::DOUBLE * (n.hit.at - c.at_s - n.d - 180) END
  FROM chain c JOIN (
    SELECT x.stream, x.place, x.talk, x.d, x.drift, x.expected, min({'minus': -x.value, 'at': x.at, 'value': x.value}) FILTER (x.value > -1) AS hit FROM (
      SELECT t.stream, t.place, t.talk, t.d, c.drift, t.due_s + c.drift AS expected, g.at_s AS at, g.score + 5 * (1 - abs(g.at_s - (t.due_s + c.drift)) / greatest(0.6::DOUBLE * t.d, 600)) + coalesce(b.bonus, 0) AS value
      FROM chain c JOIN t ON t.stream = c.stream AND t.place = c.place + 1 LEFT JOIN g ON g.stream = t.stream AND abs(g.at_s - (t.due_s + c.drift)) <= greatest(0.6::DOUBLE * t.d, 600) LEFT JOIN bonus b ON b.stream = t.stream AND b.talk = t.talk AND b.at_s = g.at_s) x
    GROUP BY ALL) n ON n.stream = c.stream AND n.place = c.place + 1)
SELECT stream, talk, at_s, round(score, 6) AS score FROM chain"""


@query(sql(ASSIGN, True))
def assign_transitions(spark, d):
    g, t = written(gaps(spark, d), "gaps"), talks(spark, d)
    rows = T.assign_transitions(t, g, T.score_gap_talk_pairs(g, T.planned_starts(t), WITHIN, F.upper))
    return rows.withColumn("score", F.round("score", 6))


def _starts(n: int) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(array_to_string(ws[1:{n}], ' '), '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {{'w': {w}, 'k': {-k}, 'label': '{label}'}} END" for k, (label, p, w) in enumerate(T.STARTS)) + "] IF x IS NOT NULL]"


REFINE = f""", v AS (SELECT stream, start_s, row_number() OVER o - 1 AS i, start_s - lag(end_s) OVER o AS gap, list(word) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ws FROM w WINDOW o AS (PARTITION BY stream ORDER BY pos)),
mk AS (SELECT stream, start_s, i, 0 AS kind, coalesce(list_sum([x.w FOR x IN f]), 0)::BIGINT AS wt, array_to_string([x.label FOR x IN f], '+') AS label, ws[1:20] AS said FROM (SELECT *, {_starts(15)} AS f FROM v WHERE gap >= 5)
  UNION ALL SELECT stream, start_s, i, 1, list_max(f).w, list_max(f).label, ws[1:10] FROM (SELECT *, {_starts(10)} AS f FROM v WHERE i % 5 = 0) WHERE len(f) > 0),
near AS (SELECT t.stream, talk, due_s, m.*, {heard('said', 'speaker')} AS named FROM t JOIN mk m ON m.stream = t.stream AND m.start_s BETWEEN due_s AND due_s + 900),
sc AS (SELECT *, wt + CASE WHEN kind = 1 THEN 8 WHEN named THEN 12 ELSE 0 END AS score, CASE WHEN kind = 1 THEN label || '+speaker' ELSE concat_ws('+', CASE WHEN named THEN 'speaker-after-gap' END, nullif(label, '')) END AS signal FROM near WHERE named OR kind = 0),
top AS (SELECT * FROM sc WHERE score >= 8 QUALIFY row_number() OVER (PARTITION BY stream, talk ORDER BY score DESC, i, kind) = 1)
SELECT t.stream, t.talk, CASE WHEN top.start_s > t.due_s THEN top.start_s ELSE t.due_s END AS start_s, CASE WHEN top.start_s > t.due_s THEN score END::BIGINT AS score, CASE WHEN top.start_s > t.due_s THEN signal ELSE '' END AS signal
FROM t LEFT JOIN top ON top.stream = t.stream AND top.talk = t.talk"""


@query(sql(REFINE))
def refine_start(spark, d):
    """From the planned starts."""
    starts = T.planned_starts(talks(spark, d)).withColumn("at_s", F.col("due_s"))
    return T.refine_start(words(spark, d), starts, code=F.upper)
