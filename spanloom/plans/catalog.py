"""Queries on typed records and on the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import catalog as K
from spanloom.sources.projections import COLLECTIONS, KEEP, project_collection

from . import adapters as A
from .adapters import table
from .adapters import with_views as V
from .registry import query

NOW = "2024-06-01T00:00:00Z"


def _raw(field, place):
    """A field's value by order key and place: absent, empty or set, in turns."""
    i, name = F.col("o_orderkey") + place, F.lit(f"{field.fields[0]}-")
    if field.kind == "long":
        return F.when(i % 3 == 1, F.lit(0)).when(i % 3 == 2, F.col("o_orderkey"))
    if field.kind == "json":
        return F.when(i % 2 == 1, F.array("o_orderkey"))
    return F.when(i % 4 == 1, F.lit("")).when(i % 4 > 1, F.concat(name, "o_orderkey"))


def records(spark, d, collection):
    """Each order as a record of the collection."""
    flat, nested = [], {}
    for place, field in enumerate(COLLECTIONS[collection]):
        parent, _, leaf = field.fields[-1].rpartition(".")
        value = _raw(field, place).alias(leaf)
        nested.setdefault(parent, []).append(value) if parent else flat.append(value)
    key = F.col("o_orderkey").cast("string")
    body = F.to_json(F.struct(*flat, *[F.struct(*inner).alias(parent) for parent, inner in nested.items()]))
    return table(spark, d, "orders").select(F.concat(F.lit("at://did:c/x/"), key).alias("uri"), F.lit("did:c").alias("did"), key.alias("rkey"), body.alias("record"))


def _expected(collection):
    out = []
    for place, f in enumerate(COLLECTIONS[collection]):
        i = f"(o_orderkey + {place})"
        if f.kind == "long":
            raw, empty = f"(CASE {i} % 3 WHEN 1 THEN 0 WHEN 2 THEN o_orderkey END)", "0"
        elif f.kind == "json":
            raw, empty = f"(CASE {i} % 2 WHEN 1 THEN '[' || o_orderkey || ']' END)", "''"
        else:
            raw, empty = f"(CASE {i} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '{f.fields[0]}-' || o_orderkey END)", "''"
        if f.empty is not KEEP:
            other = NOW if f.empty == "now" else f.empty
            raw = f"nullif({raw}, {empty})" if other is None else f"coalesce(nullif({raw}, {empty}), {other!r})"
        out.append(f'({raw})::{"BIGINT" if f.kind == "long" else "VARCHAR"} AS "{f.column}"')
    return f"SELECT 'at://did:c/x/' || o_orderkey AS uri, 'did:c' AS did, o_orderkey::VARCHAR AS rkey, {', '.join(out)} FROM orders"


def _register(collection):
    def run(spark, d):
        return project_collection(records(spark, d, collection), collection, now=NOW)

    run.__name__ = f"project_record_{collection}"
    query(_expected(collection))(run)


for _name in COLLECTIONS:
    _register(_name)


@query("""
WITH t AS (SELECT o_orderkey, 'at://did:c/talk/' || o_orderkey AS uri, CASE WHEN o_orderkey % 3 <> 0 THEN 'v' || o_orderkey END AS vod FROM orders),
s AS (SELECT l_orderkey, l_linenumber, 'S' || l_suppkey || '.Example' AS id, s_name || '/' || l_linenumber AS name, 'at://did:c/speaker/s' || l_suppkey || '-example' AS uri FROM lineitem JOIN supplier ON l_suppkey = s_suppkey SEMI JOIN orders ON o_orderkey = l_orderkey)
SELECT 'talks' AS part, uri, vod AS other, 'Talk ' || o_orderkey AS text, CASE WHEN vod IS NULL THEN 0 ELSE o_orderkey * 1500000 END::BIGINT AS amount FROM t
UNION ALL SELECT 'status', uri, NULL, NULL, 1 FROM t
UNION ALL SELECT DISTINCT 'links', 'at://did:c/talk/' || l_orderkey, uri, NULL, NULL::BIGINT FROM s
UNION ALL SELECT 'speakers', uri, id, arg_min(name, (l_orderkey, l_linenumber, name)), NULL FROM s GROUP BY uri, id""")
def ingest_tables(spark, d):
    """Orders as a schedule, their suppliers as speakers."""
    who = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    one = F.struct("l_linenumber", F.concat("s_name", F.lit("/"), "l_linenumber").alias("name"), F.concat(F.lit("S"), "l_suppkey", F.lit(".Example")).alias("id"))
    listed = who.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("speakers"))
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(listed, "o_orderkey", "left").select(
        key.alias("place"), F.concat(F.lit("at://s/x/"), key).alias("uri"), F.concat(F.lit("Talk "), key).alias("title"), F.col("o_orderpriority").alias("room"), F.col("o_orderstatus").alias("category"),
        F.col("o_orderdate").alias("starts_at"), F.col("o_orderdate").alias("ends_at"), F.when(key % 3 != 0, F.concat(F.lit("v"), key)).alias("vod_uri"), key.alias("offset_ns"), (key * 1.5).alias("coverage_ms"), "speakers",
    )
    t = K.ingest_tables(rows, "did:c")
    row = lambda part, uri, other, text, amount: t[part].select(F.lit(part).alias("part"), F.col(uri).alias("uri"), other.cast("string").alias("other"), text.cast("string").alias("text"), amount.cast("long").alias("amount"))
    none = F.lit(None)
    talks = row("talks", "uri", F.col("vod_uri"), F.col("title"), F.col("duration_ns"))
    return talks.union(row("status", "talk_uri", none, none, F.col("ingested"))).union(row("links", "talk_uri", F.col("speaker_uri"), none, none)).union(row("speakers", "uri", F.col("handle"), F.col("name"), none))


ENTRIES = """
, p AS (SELECT uri, name, aliases, string_split(name, ' ') AS ws FROM concepts),
x AS (SELECT uri, unnest(list_distinct(ws)) AS term, false AS proper FROM p UNION ALL SELECT uri, ws[1] || ' ' || ws[2], true FROM p UNION ALL SELECT uri, lower(aliases[1]), false FROM p),
e AS (SELECT term, bool_or(proper) AS proper, talk_uri AS talk, sum(mention_count)::BIGINT AS n FROM x JOIN talk_concepts c ON c.concept_uri = x.uri GROUP BY term, talk_uri),
terms AS (SELECT term, count(*) AS talks_n, sum(n)::BIGINT AS n, bool_or(proper) AS proper FROM e GROUP BY term),
rel AS (SELECT DISTINCT term, uri, name FROM (SELECT uri, name, unnest([y FOR y IN regexp_split_to_array(lower(name || ' ' || aliases[1]), '[\\s\\-_/]+') IF y <> '']) AS term FROM p)),
sh AS (SELECT e.*, rel.uri, rel.name FROM e JOIN rel USING (term) JOIN talk_concepts c ON c.concept_uri = rel.uri AND c.talk_uri = e.talk WHERE term IN (SELECT term FROM terms WHERE talks_n >= 3)),
s3 AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY term, uri ORDER BY n DESC, talk) <= 3),
sb AS (SELECT term, uri, name, count(*) AS c, string_agg(talk::VARCHAR, ',' ORDER BY n DESC, talk) AS talks FROM s3 GROUP BY ALL),
subs AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC, uri) AS place FROM sb QUALIFY place <= 3),
ot AS (SELECT e.* FROM e ANTI JOIN sh ON sh.term = e.term AND sh.talk = e.talk QUALIFY row_number() OVER (PARTITION BY e.term ORDER BY e.n DESC, e.talk) <= 5),
ol AS (SELECT term, string_agg(talk::VARCHAR, ',' ORDER BY n DESC, talk) AS talks FROM ot GROUP BY term),
al AS (SELECT lower(aliases[1]) AS term, arg_max(name, uri) AS label FROM p GROUP BY 1),
kn AS (SELECT DISTINCT term, uri FROM rel SEMI JOIN terms USING (term)),
pr AS (SELECT a.term, b.term AS label, count(*) AS c FROM kn a JOIN kn b USING (uri) WHERE a.term <> b.term GROUP BY ALL HAVING count(*) >= 2),
sa AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC, label) AS place FROM pr QUALIFY place <= 5),
inv AS (SELECT string_split(term, ' ')[2] || ', ' || string_split(term, ' ')[1] AS term, term AS label FROM terms WHERE proper),
al2 AS (SELECT term, 'entry' AS role, 0 AS place, NULL AS label, coalesce(talks, '') AS talks, n FROM terms LEFT JOIN ol USING (term)
UNION ALL SELECT term, 'subentry', place, name, talks, c FROM subs
UNION ALL SELECT term, 'see', 1, label, '', 0 FROM terms JOIN al USING (term)
UNION ALL SELECT term, 'see also', place, label, '', 0 FROM sa
UNION ALL SELECT term, 'inversion', 1, label, '', 0 FROM inv)
SELECT term, role, place::INTEGER AS place, label, talks, n::BIGINT AS n FROM al2 WHERE lower(term) NOT IN (SELECT lower(name) FROM subs WHERE name LIKE '% %')"""


@query(V(ENTRIES, "concepts", "talk_concepts"))
def enrich_index(spark, d):
    """Words, pairs and brands of part names as terms, in the talks of their parts."""
    c = A.concepts(spark, d)
    ws = F.split("name", " ")
    x = c.select("uri", F.explode(F.array_distinct(ws)).alias("term"), F.lit(False).alias("proper")).union(c.select("uri", F.concat_ws(" ", ws[0], ws[1]), F.lit(True))).union(c.select("uri", F.lower(F.col("aliases")[0]), F.lit(False)))
    tc = A.talk_concepts(spark, d)
    e = x.join(tc, x.uri == tc.concept_uri).groupBy("term", F.col("talk_uri").alias("talk")).agg(F.max("proper").alias("proper"), F.sum("mention_count").alias("n"))
    rows = K.enrich_index(e, c, tc.select("concept_uri", F.col("talk_uri").alias("talk")))
    return rows.withColumn("talks", F.array_join("talks", ","))


@query(V("""
, w AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS stream, doc_id, pos, word, byte_start, byte_end, pos * 2.0::DOUBLE + doc_id % 7 AS s FROM words),
st AS (SELECT stream, max(end_s) AS d FROM diarization GROUP BY stream),
t AS (SELECT strftime(DATE '2024-01-01' + (o_orderkey % 40)::INTEGER, '%Y-%m-%d') AS stream, o_orderkey AS talk, (o_orderkey // 40 * 7)::DOUBLE AS s, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey // 40 * 7 + 5)::DOUBLE END AS e FROM orders),
a AS (SELECT stream, 'talk' AS part, s AS "start", coalesce(nullif(e, 0), lead(s) OVER (PARTITION BY stream ORDER BY s, talk)) AS "end", talk::VARCHAR AS label FROM t
UNION ALL SELECT stream, 'speech', start_s, end_s, speaker FROM diarization
UNION ALL SELECT stream, 'word', s, s + 1, word FROM w
UNION ALL SELECT stream, 'paragraph', byte_start, byte_end, NULL FROM w WHERE pos % 40 = 0)
SELECT stream, 'stream' AS part, 0::DOUBLE AS "start", d AS "end", 'Day ' || stream AS label FROM st UNION ALL SELECT a.* FROM a SEMI JOIN st USING (stream)""", "words", "diarization"))
def track_detail(spark, d):
    di = A.diarization(spark, d)
    day = lambda n: F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), n.cast("int")), "yyyy-MM-dd")
    streams = di.groupBy("stream").agg(F.max("end_s").alias("duration_s")).withColumn("name", F.concat(F.lit("Day "), "stream"))
    k = F.col("o_orderkey")
    start = (F.floor(k / 40) * 7).cast("double")
    talks = table(spark, d, "orders").select(day(k % 40).alias("stream"), k.alias("talk"), start.alias("start_s"), F.when(k % 3 == 0, start + 5).alias("end_s"))
    s = F.col("pos") * 2.0 + F.col("doc_id") % 7
    w = A.words(spark, d).select(day(F.col("doc_id") % 30).alias("stream"), "pos", "word", "byte_start", "byte_end", s.alias("start_s"), (s + 1).alias("end_s"))
    return K.track_detail(streams, talks, di, w, w.where("pos % 40 = 0").withColumn("kind", F.lit("paragraph")))
