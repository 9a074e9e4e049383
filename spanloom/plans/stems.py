"""Queries on stems; the SQL is written from the same tables of suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import stemming as P
from spanloom.functions.text import slug_to_rkey as rkey
from spanloom.functions.text import tokenize_alpha
from spanloom.operators import entities as E

from . import adapters as A
from .adapters import table
from .registry import query


def _shape(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '([^aeiou])y', '\\1Y', 'g'), '[aeiouY]', '#', 'g'), '[^#]', 'c', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, '#+c+'))"


def _less(n: int) -> str:
    return f"left(x, greatest(length(x) - {n}, 0))"


def _short(x: str) -> str:
    return f"((regexp_matches({_shape(x)}, 'c#c$') AND NOT regexp_matches({x}, '[wxy]$')) OR {_shape(x)} = '#c')"


def _ruled(rules) -> str:
    each = ""
    for suffix, put, least in rules:
        fine = "true" if least < 0 else f"{_measure(_less(len(suffix)))} > {least}"
        fine += f" AND regexp_matches({_less(3)}, '[st]$')" if suffix == "ion" else ""
        each += f" WHEN x LIKE '%{suffix}' THEN CASE WHEN {fine} THEN {_less(len(suffix))} || '{put}' ELSE x END"
    return f"CASE{each} ELSE x END"


_DOUBLED = " OR ".join(f"x LIKE '%{c}{c}'" for c in "bcdfghjklmnpqrstvwxz")
_MENDED = f"CASE WHEN NOT cut THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN {_DOUBLED} THEN CASE WHEN regexp_matches(x, '[lsz]$') THEN x ELSE {_less(1)} END WHEN {_measure('x')} = 1 AND {_short('x')} THEN x || 'e' ELSE x END"
_PAST = f"""CASE WHEN regexp_matches(x, '^.ied$') THEN {_less(1)} WHEN x LIKE '%ied' THEN {_less(2)} WHEN x LIKE '%eed' THEN CASE WHEN {_measure(_less(3))} > 0 THEN {_less(1)} ELSE x END
  WHEN x LIKE '%ed' AND contains({_shape(_less(2))}, '#') THEN {_less(2)} WHEN x LIKE '%ing' AND contains({_shape(_less(3))}, '#') THEN {_less(3)} ELSE x END"""
_CUT = f"x NOT LIKE '%ied' AND x NOT LIKE '%eed' AND ((x LIKE '%ed' AND contains({_shape(_less(2))}, '#')) OR (x NOT LIKE '%ed' AND x LIKE '%ing' AND contains({_shape(_less(3))}, '#')))"
_ODD = "(VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in P.IRREGULAR.items()) + ") AS odd(w, s)"
#: Below a CTE ``said`` (w): ``stems`` (w, s).
STEMS = f""", s1 AS (SELECT w, CASE WHEN regexp_matches(x, '^.ies$') THEN {_less(1)} ELSE {_ruled(P.PLURALS)} END AS x FROM (SELECT DISTINCT w, w AS x FROM said)),
s2 AS (SELECT w, {_MENDED} AS x FROM (SELECT w, {_PAST} AS x, {_CUT} AS cut FROM s1)),
s3 AS (SELECT w, CASE WHEN x LIKE '%y' AND length(x) > 2 AND {_shape(_less(1))} LIKE '%c' THEN {_less(1)} || 'i' ELSE x END AS x FROM s2),
s4 AS (SELECT w, CASE WHEN x LIKE '%logi' THEN CASE WHEN {_measure(_less(3))} > 0 THEN {_less(1)} ELSE x END ELSE {_ruled(P.DOUBLE)} END AS x FROM (SELECT w, CASE WHEN x LIKE '%alli' AND {_measure(_less(4))} > 0 THEN {_less(2)} ELSE x END AS x FROM s3)),
s5 AS (SELECT w, {_ruled(P.FULL)} AS x FROM s4), s6 AS (SELECT w, {_ruled(P.LONG)} AS x FROM s5),
s7 AS (SELECT w, CASE WHEN x LIKE '%ll' AND {_measure(_less(1))} > 1 THEN {_less(1)} ELSE x END AS x FROM (SELECT w, CASE WHEN x LIKE '%e' AND ({_measure(_less(1))} > 1 OR ({_measure(_less(1))} = 1 AND NOT {_short(_less(1))})) THEN {_less(1)} ELSE x END AS x FROM s6)),
stems AS (SELECT s7.w, coalesce(odd.s, CASE WHEN length(s7.w) <= 2 THEN s7.w ELSE x END) AS s FROM s7 LEFT JOIN {_ODD} ON odd.w = s7.w)"""
ENDINGS = ("s", "ies", "ied", "ing", "edly", "ational", "iveness", "ility", "logy", "ally", "ement")


@query(f"WITH base AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM documents), said AS (SELECT b || e AS w FROM base, (SELECT unnest(['', {', '.join(repr(e) for e in ENDINGS)}]) AS e)){STEMS} SELECT w AS word, s AS stem FROM stems")
def stem_words(spark, d):
    """The distinct words of all documents, as they are and with endings that rules are about."""
    words = table(spark, d, "documents").select(F.explode(tokenize_alpha(F.col("text"))).alias("b")).distinct()
    said = words.select(F.explode(F.array(*[F.concat("b", F.lit(e)) for e in ("", *ENDINGS)])).alias("word")).distinct()
    return said.select("word", P.stem(F.col("word")).alias("stem"))


_NAMES = "SELECT p_partkey AS uri, p_name || 'ing (' || p_brand || ') ' || p_type || 's / ' || p_brand AS name, p_size > 25 AS d FROM part"
_KEYS = rf"WITH names AS ({_NAMES}), cut AS (SELECT *, trim(regexp_replace(lower(string_split(regexp_replace(name, '\s*\([^)]*\)\s*', ' ', 'g'), '/')[1]), '\s+', ' ', 'g'), ' .,;:-') AS plain FROM names), each AS (SELECT uri, unnest(range(len(string_split(plain, ' ')))) AS i, unnest(string_split(plain, ' ')) AS w FROM cut), said AS (SELECT DISTINCT w FROM each){STEMS}, keys AS (SELECT uri, string_agg(s, '' ORDER BY i) AS key FROM each JOIN stems USING (w) GROUP BY uri)"


def _named(spark, d):
    name = F.concat("p_name", F.lit("ing ("), "p_brand", F.lit(") "), "p_type", F.lit("s / "), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), name.alias("name"), F.when(F.col("p_size") > 25, "x").alias("description"), F.array("p_brand").alias("aliases"))


@query(f"{_KEYS} SELECT uri, key FROM keys")
def stem_key(spark, d):
    return _named(spark, d).select("uri", P.stem_key(F.col("name")).alias("key"))


@query(f"{_KEYS} SELECT key AS cluster_key, arg_min(uri, (NOT d, length(name), uri)) AS canonical, count(*)::BIGINT AS n FROM keys JOIN names USING (uri) GROUP BY key")
def stem_clusters(spark, d):
    """Concepts clustered by their stemmed names."""
    return E.concept_clusters(_named(spark, d), P.stem_key(F.col("name"))).select("cluster_key", "canonical", "n")


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(left(text, 700))), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 512) AS rkey FROM documents WHERE text IS NOT NULL")
def slug_to_rkey(spark, d):
    """Keys of the first 700 characters of each text, as of a long title."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", rkey(F.substring("text", 1, 700)).alias("rkey"))
