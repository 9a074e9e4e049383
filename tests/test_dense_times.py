"""Talks, recordings and words that crowd at the same times: known answers and a plain search."""

import random
import time

from pyspark.sql import functions as F

from spanloom.operators import align as L
from spanloom.operators import reads as R

N = 40_000


def crowd(spark):
    """N talks of one start and N recordings around it: pairs of single rows would be 1.6 billion."""
    at = F.lit("2024-01-01 10:00:00").cast("timestamp")
    talks = spark.range(N).select("id", F.lit(1).alias("room"), at.alias("starts_at"), (at + F.expr("INTERVAL 45 MINUTES")).alias("ends_at"))
    vods = spark.range(N).select(F.format_string("v%05d", "id").alias("vod_uri"), F.lit(1).alias("room"), (at + F.expr("INTERVAL 10 MINUTES")).alias("created_at"), (900 + F.col("id") % 3).alias("duration_s"))
    return talks, vods


def test_time_window_match_of_a_crowd(spark):
    talks, vods = crowd(spark)
    t = time.time()
    got = R.time_window_match(talks.withColumnRenamed("id", "uri"), vods).groupBy("vod_uri", "offset_s", "covered_s").count().collect()
    assert [tuple(r) for r in got] == [("v39999", 300, 600, N)] and time.time() - t < 60


def test_realign_vod_of_a_crowd(spark):
    talks, vods = crowd(spark)
    odd = talks.select(F.col("id").alias("talk"), F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("room"), "starts_at", F.lit(3.0).alias("ratio"))
    allowed = spark.createDataFrame([(1, 1), (2, 7)], "talk_room int, room int")
    t = time.time()
    got = L.realign_vod(odd, vods, allowed).groupBy("vod_uri").count().collect()
    assert [tuple(r) for r in got] == [("v39998", N)] and time.time() - t < 60


def test_assign_speakers_as_a_plain_search_does(spark):
    rng = random.Random(3)
    seg = [(f"s{i % 2}", i, a := rng.randrange(60) / 2, a + rng.randrange(-2, 16) / 2, f"p{i}") for i in range(30)]
    words = [(f"s{i % 3}", i, a := rng.randrange(-10, 100) / 2, a + 0.5) for i in range(120)]
    got = {(r["stream"], r["pos"]): r["speaker"] for r in L.assign_speakers(spark.createDataFrame(words, "stream string, pos int, start_s double, end_s double"), spark.createDataFrame(seg, "stream string, event_id int, start_s double, end_s double, speaker string")).collect()}
    assert len(got) == len(words)
    for stream, pos, a, b in words:
        mid, own = (a + b) / 2, [s for s in seg if s[0] == stream]
        inside = min(((s[2], s[1], s[4]) for s in own if s[2] <= mid <= s[3]), default=None)
        e, s = max((x[3] for x in own if x[3] <= mid), default=None), min((x[2] for x in own if x[2] >= mid), default=None)
        left = e is not None and (s is None or mid - e <= s - mid)
        fine = {inside[2]} if inside else {x[4] for x in own if (x[3] == e if left else x[2] == s)} or {None}
        assert got[stream, pos] in fine
    # a crowd: every word in every segment
    t = time.time()
    many = spark.range(N).select(F.lit("s").alias("stream"), F.col("id").alias("pos"), F.lit(5.0).alias("start_s"), F.lit(6.0).alias("end_s"))
    over = spark.range(N).select(F.lit("s").alias("stream"), F.col("id").alias("event_id"), F.lit(1.0).alias("start_s"), F.lit(9.0).alias("end_s"), F.concat(F.lit("p"), "id").alias("speaker"))
    assert [tuple(r) for r in L.assign_speakers(many, over).groupBy("speaker").count().collect()] == [("p0", N)] and time.time() - t < 60


def test_zones_of_one_time_meet_segments_once(spark):
    from spanloom.operators import sequence as S

    t = time.time()
    zones = spark.range(N).select(F.lit("s").alias("stream"), F.col("id").alias("zone"), F.lit(10.0).alias("zone_start"), F.lit(110.0).alias("zone_end"))
    segments = spark.range(N).select(F.lit("s").alias("stream"), F.col("id").alias("event_id"), (F.col("id") % 2 * 50 + 5.0).alias("start_s"), (F.col("id") % 2 * 50 + 15.0).alias("end_s"))
    got = S.zone_speech_chunks(zones, segments).groupBy("chunk", "start_s", "end_s").count().collect()
    assert [tuple(r) for r in got] == [(0, 10.0, 65.0, N)] and time.time() - t < 60


def test_snaps_among_dense_targets(spark):
    """20,000 targets within the radius of 200 asked times: the nearest of the best rank, without a pair of each."""
    from spanloom.operators import boundaries as B

    targets = spark.range(20_000).selectExpr("'s' AS stream", "id / 1000D AS at_s", "CAST(1 + id % 2 AS int) AS priority")
    asked = spark.range(200).selectExpr("'s' AS stream", "id / 10D + 0.0005D AS asked_s")
    rows = B.nearest_snap(targets.union(spark.sql("SELECT 't', 1D, 2")), asked.union(spark.sql("SELECT 't', 99D")), 30.0)
    assert "_bucket" not in rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "extended")
    got = {r["asked_s"]: (r["at_s"], r["priority"]) for r in rows.collect()}
    assert len(got) == 200 and all(abs(at - (a - 0.0005)) < 1e-9 and p == 1 for a, (at, p) in got.items())


def test_rows_of_other_keys_go_before_the_shuffle(spark):
    from spanloom.operators.intervals import of_keys

    rows, spans = spark.range(1000).selectExpr("id % 100 AS doc_id", "id AS pos"), spark.createDataFrame([(3,), (3,), (500,)], "doc_id long")
    kept = of_keys(rows, spans, ["doc_id"])
    assert kept.count() == 10 and {r["doc_id"] for r in kept.collect()} == {3}
    assert "Exchange hashpartitioning" not in rows._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
