"""The library's relations as views over the test tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import tokenize_ws
from spanloom.functions.timing import spread, text_words, word_lists, words_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("room"), (1000 * (F.col("doc_id") % 7)).alias("start_ms"))


def _gap(pos):
    return F.when((pos > 0) & ((pos * 7 + F.col("doc_id")) % 41 == 0), 2500).otherwise(0).cast("long")


def timed_transcripts(spark, d) -> DataFrame:
    """Transcripts with made-up times: 80 ms and 20 for each character, and now and then a pause of 2.5 s before."""
    dur = lambda w: (80 + 20 * F.length(w)).cast("long")
    pairs = F.transform(tokenize_ws(F.col("text")), lambda w, i: F.array(F.when(i == 0, F.col("start_ms")).otherwise(_gap(i)).cast("long"), dur(w)))
    return spread(transcripts(spark, d)).select("doc_id", "text", "start_ms", F.flatten(pairs).alias("timings"), F.lit("pairs").alias("encoding"))


def words(spark, d, following: bool = False) -> DataFrame:
    timed = words_table(timed_transcripts(spark, d), following=following)
    return timed.withColumns({"dur_ms": F.col("end_ms") - F.col("start_ms"), "gap_ms": _gap(F.col("pos"))})


def listed_words(spark, d) -> DataFrame:
    """(doc_id, ws): the words of each document as one list."""
    return word_lists(timed_transcripts(spark, d))


def placed_words(spark, d) -> DataFrame:
    """(doc_id, pos, word, byte_start, byte_end): the words without times."""
    return text_words(spread(transcripts(spark, d)))


def heard_words(spark, d) -> DataFrame:
    """The words alone, which need no times and so no pass through Python."""
    return spread(transcripts(spark, d)).select(F.explode(tokenize_ws(F.col("text"))).alias("word"))


def diarization(spark, d) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")) / 5
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("stream"), F.round(second, 3).alias("start_s"), (F.round(second, 3) + F.col("value") / 2).alias("end_s"), F.col("event_type").alias("speaker"))


def streamed_words(spark, d, step: float, length: float) -> DataFrame:
    """The words of each document on the stream of one day, ``step`` seconds apart; pos is unique in a stream. They need no
    times of their own and so no pass through Python."""
    stream = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    start = F.col("pos") * step + F.col("doc_id") % 7
    said = spread(transcripts(spark, d)).select("doc_id", F.posexplode(tokenize_ws(F.col("text"))).alias("pos", "word"))
    return said.select(stream.alias("stream"), (F.col("doc_id") * 100_000 + F.col("pos")).alias("pos"), "word", start.alias("start_s"), (start + length).alias("end_s"))


def asr_segments(spark, d) -> DataFrame:
    rows = diarization(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id")
    return rows.select("event_id", "stream", "start_s", "end_s", (-F.col("value") / 50).alias("avg_logprob"), ((F.col("event_id") % 10) / 10).alias("no_speech_prob"))


def talks(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), F.concat(F.lit("Talk "), F.col("o_orderkey")).alias("title"), F.col("o_orderdate").alias("starts_at"), F.col("o_orderpriority").alias("room"), F.col("o_orderstatus").alias("category"), (F.col("o_totalprice") / 100).alias("duration_s"))


def speakers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("uri"), F.col("s_name").alias("name"))


def talk_speakers(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("talk_uri"), F.col("l_suppkey").alias("speaker_uri")).distinct()


def concepts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("description"))


def talk_concepts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("talk_uri"), F.col("l_partkey").alias("concept_uri")).agg(F.count("*").alias("mention_count"))


def comments(spark, d) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "click", "\U0001f44d").when(kind == "view", "❤").otherwise(kind)
    start = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 13) % 900)
    return table(spark, d, "events").select(F.col("event_id").alias("uri"), F.col("user_id").alias("author"), (F.col("event_id") % 1500).alias("subject_uri"), text.alias("text"), start.alias("byte_start"), (start + 5 + F.col("event_id") % 40).alias("byte_end"), F.col("ts").cast("timestamp").alias("created_at"))


def mentions(spark, d) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    kinds = F.element_at(F.array(F.lit("post"), F.lit("blog"), F.lit("video"), F.lit("photo")), (c % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select((c * 1000 + t).alias("uri"), F.when(t > 0, c * 1000).alias("parent_uri"), (c * 7 + t).alias("author"), "text", (F.length("text") % 97).cast("long").alias("likes"), kinds.alias("content_type"), c.alias("talk_uri"), (t * 5000 + c % 11).alias("offset_ms"), F.when(c % 2 == 0, "during_talk").otherwise("post_talk").alias("mention_type"))


def profiles(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("did"), F.col("c_name").alias("handle"))


def commits(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    return table(spark, d, "events").select(F.col("user_id").alias("uri"), kind.alias("operation"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.col("event_id").alias("rev"), F.col("props").alias("record"))


def sentence_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("doc"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def schedule(spark, d) -> DataFrame:
    start = F.col("o_orderdate") - F.expr("INTERVAL 10 MINUTES")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), (F.col("o_orderkey") % 5).alias("room"), start.alias("starts_at"), (start + F.expr("INTERVAL 45 MINUTES")).alias("ends_at"))


def vods(spark, d) -> DataFrame:
    created, secs = F.col("l_shipdate"), (F.col("l_quantity") * 60).cast("long")
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("vod_uri"), (F.col("l_suppkey") % 5).alias("room"), created.alias("created_at"), secs.alias("duration_s"))


def ground_truth(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("start_s"), F.lit(120.0).alias("tolerance_s"), (F.col("toxic") == 0).alias("verified"))


def detected(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").where("doc_id % 11 <> 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") * 37) % 300).cast("double").alias("found_s"))


#: The same views as SQL, by name; each may name the ones before it.
SQL = {
    "transcripts": "SELECT doc_id, text, source AS room, 1000 * (doc_id % 7) AS start_ms FROM documents",
    "token_lists": r"SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents",
    "word_rows": "SELECT doc_id, unnest(range(0, len(ws)))::INTEGER AS pos, unnest(ws) AS word FROM token_lists",
    "timed_rows": "SELECT *, (80 + 20 * length(word))::BIGINT AS dur_ms, (CASE WHEN pos > 0 AND (pos * 7 + doc_id) % 41 = 0 THEN 2500 ELSE 0 END)::BIGINT AS gap_ms FROM word_rows",
    "words": "SELECT doc_id, pos, word, dur_ms, gap_ms, (sum(strlen(word) + 1) OVER o - 1 - strlen(word))::BIGINT AS byte_start, (sum(strlen(word) + 1) OVER o - 1)::BIGINT AS byte_end, (1000 * (doc_id % 7) + sum(dur_ms + gap_ms) OVER o)::BIGINT AS end_ms, (1000 * (doc_id % 7) + sum(dur_ms + gap_ms) OVER o - dur_ms)::BIGINT AS start_ms FROM timed_rows WINDOW o AS (PARTITION BY doc_id ORDER BY pos)",
    "diarization": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS stream, round((hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1e6) / 5, 3) AS start_s, round((hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1e6) / 5, 3) + value / 2 AS end_s, event_type AS speaker FROM events",
    "asr_segments": "SELECT d.event_id, stream, start_s, end_s, -value / 50 AS avg_logprob, (d.event_id % 10) / 10 AS no_speech_prob FROM diarization d JOIN events e ON d.event_id = e.event_id",
    "talks": "SELECT o_orderkey AS uri, 'Talk ' || o_orderkey AS title, o_orderdate AS starts_at, o_orderpriority AS room, o_orderstatus AS category, o_totalprice / 100 AS duration_s FROM orders",
    "speakers": "SELECT s_suppkey AS uri, s_name AS name FROM supplier",
    "talk_speakers": "SELECT DISTINCT l_orderkey AS talk_uri, l_suppkey AS speaker_uri FROM lineitem",
    "concepts": "SELECT p_partkey AS uri, p_name AS name, [p_brand] AS aliases, CASE WHEN p_size > 25 THEN p_type END AS description FROM part",
    "talk_concepts": "SELECT l_orderkey AS talk_uri, l_partkey AS concept_uri, count(*)::BIGINT AS mention_count FROM lineitem GROUP BY ALL",
    "comments": "SELECT event_id AS uri, user_id AS author, event_id % 1500 AS subject_uri, CASE event_type WHEN 'click' THEN '👍' WHEN 'view' THEN '❤' ELSE event_type END AS text, CASE WHEN event_id % 2 = 0 THEN event_id * 13 % 900 END AS byte_start, CASE WHEN event_id % 2 = 0 THEN event_id * 13 % 900 + 5 + event_id % 40 END AS byte_end, ts AS created_at FROM events",
    "mentions": "SELECT conv_id * 1000 + turn AS uri, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_uri, conv_id * 7 + turn AS author, text, (length(text) % 97)::BIGINT AS likes, (['post', 'blog', 'video', 'photo'])[conv_id % 4 + 1] AS content_type, conv_id AS talk_uri, turn * 5000 + conv_id % 11 AS offset_ms, CASE WHEN conv_id % 2 = 0 THEN 'during_talk' ELSE 'post_talk' END AS mention_type FROM conversations",
    "profiles": "SELECT c_custkey AS did, c_name AS handle FROM customer WHERE c_custkey % 3 <> 0",
    "commits": "SELECT user_id AS uri, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'update' END AS operation, epoch_us(ts) AS time_us, event_id AS rev, props AS record FROM events",
    "sentence_vectors": "SELECT label AS doc, vec_id, embedding::DOUBLE[] AS vector FROM embeddings",
    "schedule": "SELECT o_orderkey AS uri, o_orderkey % 5 AS room, o_orderdate - INTERVAL 10 MINUTE AS starts_at, o_orderdate + INTERVAL 35 MINUTE AS ends_at FROM orders",
    "vods": "SELECT l_orderkey || '-' || l_linenumber AS vod_uri, l_suppkey % 5 AS room, l_shipdate AS created_at, (l_quantity * 60)::BIGINT AS duration_s FROM lineitem",
    "ground_truth": "SELECT doc_id, n_chars::DOUBLE AS start_s, 120.0::DOUBLE AS tolerance_s, toxic = 0 AS verified FROM labels JOIN documents USING (doc_id)",
    "detected": "SELECT doc_id, (n_chars + doc_id * 37 % 300)::DOUBLE AS found_s FROM labels JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0",
}
NEEDS = {"word_rows": ["token_lists"], "timed_rows": ["token_lists", "word_rows"], "words": ["token_lists", "word_rows", "timed_rows"], "asr_segments": ["diarization"]}


def with_views(sql: str, *views: str) -> str:
    """``sql`` (which may begin with further CTEs and a comma) below the views it needs."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}{sql}" if sql.lstrip().startswith(",") else f"WITH {head}\n{sql}"
