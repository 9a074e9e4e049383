"""Streams of many words: which may have loops, and texts of crowded windows."""

from pyspark.sql import functions as F

from spanloom.operators import matching as M
from spanloom.operators import sequence as S
from spanloom.operators import spans as P


def said(spark, texts):
    rows = [(k, i, w, i * 500.0 if k == "far" else float(i), i + 0.5) for k, text in texts.items() for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "stream string, pos int, word string, start_s double, end_s double")


def test_only_streams_that_may_loop_are_looked_at(spark):
    texts = {
        "plain": "all of these words are by no means a phrase " * 5,
        "thanks": "some words THANK you for watching, and " * 4,
        "half": "thank you all for this and thank you all " * 4,  # no "watching"
        "dots": "see otter.ai now " * 4,
        "titles": "Subtitles by us, subtitle by you, SUBTITLES by all " * 2,
        "zeros": "0 " * 30,
        "few": "0 " * 19,
    }
    words = said(spark, texts)
    loops = S.may_loop(words, key="stream")
    assert {r["stream"] for r in loops.select("stream").distinct().collect()} == {"thanks", "dots", "titles", "zeros"}
    assert loops.count() == sum(len(texts[k].split()) for k in ("thanks", "dots", "titles", "zeros"))
    segments = words.select("stream", F.col("pos").alias("event_id"), "start_s", "end_s")
    zones = sorted(map(tuple, P.zones_of(words, segments).collect()))
    assert zones == sorted(map(tuple, P.zones_of(words, segments, loops).collect())) and {z[0] for z in zones} == {"thanks", "dots", "titles", "zeros"}
    other = [(r"thank.*watching", "any", 4)]
    assert S.may_loop(words, other, key="stream").count() == words.count()  # parts that may cross words


def test_texts_of_windows_in_parts(spark):
    words = spark.range(3000).select(F.lit("s").alias("stream"), (F.col("id") % 2).alias("window"), (5000 - F.col("id")).alias("pos"), F.concat(F.lit("w"), F.col("id")).alias("word"))
    texts = {r["window"]: r["text"] for r in M.window_texts(words, ["stream", "window"], 7).collect()}
    assert texts == {k: " ".join(f"w{i}" for i in range(2999, -1, -1) if i % 2 == k) for k in (0, 1)}


def test_words_meet_few_windows_without_a_shuffle(spark):
    words = spark.range(1000).selectExpr("'s' AS stream", "id AS pos", "'word' AS word", "id * 3D AS start_s", "id * 3D + 1 AS end_s")
    gaps = spark.createDataFrame([("s", 1, 0.0, 10.0, "a"), ("s", 2, 500.0, 600.0, "b")], "stream string, event_id int, start_s double, end_s double, speaker string")
    zones = S.silence_mismatch_zones(words, gaps)
    plan = zones._sc._jvm.PythonSQLUtils.explainString(zones._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r)[:3] for r in zones.collect()] == [("s", 12.0, 499.0)]
