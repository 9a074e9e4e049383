"""Scores of gaps: words are made where they are needed."""

from pyspark.sql import functions as F

from spanloom.operators import boundaries as B


def test_words_are_made_where_needed(spark):
    """Structs that ``each`` makes give the same gaps, and gaps meet the segments in one join."""
    rows = [("s", i, f"w{i}", float(i + (40 if i >= 25 else 0)), i + 0.5 + (40 if i >= 25 else 0), "ab"[i // 25]) for i in range(50)]
    words = spark.createDataFrame(rows, "stream string, pos int, word string, start_s double, end_s double, speaker string")
    asr = spark.createDataFrame([("s", 50.0, 51.0, -2.0, 0.9), ("s", 70.0, 71.0, -2.0, 0.1), ("s", 5.0, 6.0, -9.0, 0.9)], "stream string, start_s double, end_s double, avg_logprob double, no_speech_prob double")
    plain = B.score_gaps(words, asr)
    other = words.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.concat("speaker", "word").alias("both")))).alias("ws"))
    each = lambda w: F.struct(w["pos"].alias("pos"), F.substring(w["both"], 2, 9).alias("word"), w["s"].alias("start_s"), w["e"].alias("end_s"), F.substring(w["both"], 1, 1).alias("speaker"))
    listed = B.score_gaps(other, asr, each=each)
    joins = listed._sc._jvm.PythonSQLUtils.explainString(listed._jdf.queryExecution(), "simple").count("Join")
    assert joins == 2 and listed.collect() == plain.collect() and [(r["at_s"], r["score"]) for r in plain.collect()] == [(65.0, 15 + (40.5 - 30) / 3 + 15 - 6 - 2)]
