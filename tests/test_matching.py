"""Second pass and whole chain on one small stream: every score and choice is known; the second pass against a plain loop."""

from pyspark.sql import functions as F

from spanloom.operators import matching as M

TALKS = "stream string, talk long, title string, speakers array<string>, starts_s double"
SEGMENTS = "stream string, segment long, start_s double, end_s double, kind string"
SIGNALS = "stream string, segment long, source string, name string"


def fixture(spark):
    talks = [("d", 1, "Quiet rivers flow", ["Ada Li"], 0.0), ("d", 2, "Stone bridges", ["Grace Oh"], 600.0), ("d", 3, "Paper lanterns", ["Alan Wu"], 1200.0), ("d", 4, "Later things", ["Tony Xu"], 9000.0), ("d", 5, "No time", ["Ida Xu"], None)]
    segments = [("d", 1, 100.0, 650.0, "single-speaker"), ("d", 2, 700.0, 1250.0, "single-speaker"), ("d", 3, 1290.0, 1900.0, "single-speaker"), ("d", 4, 8000.0, 8100.0, "panel")]
    signals = [("d", 1, "self-intro", "Ada"), ("d", 1, "topic", "quiet"), ("d", 1, "topic", "rivers"), ("d", 2, "topic", "stone"), ("d", 3, "topic", "bridges")]
    return spark.createDataFrame(talks, TALKS), spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(signals, SIGNALS)


def test_first_and_second_pass(spark):
    talks, segments, signals = fixture(spark)
    first = M.match_segments(signals, segments, talks)
    assert [(r["segment"], r["talk"], r["confidence"], r["score"]) for r in first.collect()] == [(1, 1, "high", 6.5)]
    second = M.match_leftovers(signals, segments, talks, first)
    got = sorted((r["segment"], r["talk"], r["confidence"]) for r in second.collect())
    # 2 takes "Stone bridges" by a word; 3 then has only talk 3, near in time; 4 is paired in order, as talk 4 is due 900 s later
    assert got == [(2, 2, "medium"), (3, 3, "low"), (4, 4, "low")]


def test_second_pass_leaves_several_timely_talks_alone(spark):
    talks, segments, _ = fixture(spark)
    none = spark.createDataFrame([], SIGNALS)
    first = M.match_segments(none, segments, talks)
    assert first.count() == 0
    got = sorted((r["segment"], r["talk"], r["score"]) for r in M.match_leftovers(none, segments, talks, first).collect())
    # each of 1 to 3 is near two talks or three, so all go by order
    assert [(s, t) for s, t, _ in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_reconcile_and_empty_tables(spark):
    talks, segments, signals = fixture(spark)
    first = M.match_segments(signals, segments, talks)
    zones = spark.createDataFrame([("d", 8900.0, 9100.0)], "stream string, start_s double, end_s double")
    lengths = spark.createDataFrame([("d", 9000.0)], "stream string, duration_s double")
    got = sorted((r["status"], r["talk"] or 0, r["segment"] or 0, r["end_s"]) for r in M.reconcile(first, segments, talks, zones, lengths).collect())
    assert got == [("matched", 1, 0, 650.0), ("open segment", 0, 2, 1250.0), ("open segment", 0, 3, 1900.0), ("open segment", 0, 4, 8100.0), ("open talk", 2, 0, None), ("open talk", 3, 0, None), ("open talk", 5, 0, None), ("unverifiable", 4, 0, None)]
    assert M.reconcile(first.limit(0), segments.limit(0), talks.limit(0), zones, lengths).count() == 0


def test_names_are_heard_by_sound(spark):
    talks, segments, _ = fixture(spark)
    words = spark.createDataFrame([("d", i, w, 700.0 + i, 700.5 + i) for i, w in enumerate("so greyce here and my name is Alun".split())], "stream string, pos long, word string, start_s double, end_s double")
    got = {(r["segment"], r["source"], r["name"]) for r in M.segment_signals(words, segments, talks).where(F.col("source") != "topic").collect()}
    assert {(2, "self-intro", "Alun"), (2, "name-scan", "Alan"), (2, "name-scan", "Grace")} <= got


def test_whole_chain(spark):
    """Known answers from words, speakers and a schedule to one row a talk; names are heard by the phonetic code."""
    said = [(100, "good day my name is Ada and quiet rivers are"), (700, "thanks my name is Greyce and so"), (1300, "now paper lanterns by night"), (5000, "nobody speaks here")]
    words = [("d", 1000 * k + i, w, at + 1.0 + i, at + 1.5 + i) for k, (at, text) in enumerate(said) for i, w in enumerate(text.split())]
    turns = [("d", 1, 100.0, 640.0, "A"), ("d", 2, 700.0, 1240.0, "B"), ("d", 3, 1300.0, 1900.0, "C"), ("d", 4, 8000.0, 8100.0, "A")]
    talks = [("d", 1, "Quiet rivers flow", ["Ada Li"], 0.0), ("d", 2, "Stone bridges", ["Grace Oh"], 600.0), ("d", 3, "Paper lanterns", ["Alan Wu"], 1200.0), ("d", 4, "Later things", ["Tony Xu"], 5002.0), ("d", 5, "Last of all", ["Ida Xu"], 20_000.0)]
    args = (
        spark.createDataFrame(words, "stream string, pos long, word string, start_s double, end_s double"), spark.createDataFrame(turns, "stream string, event_id long, start_s double, end_s double, speaker string"),
        spark.createDataFrame(talks, TALKS), spark.createDataFrame([("d", 9000.0)], "stream string, duration_s double"),
    )
    got = sorted((r["status"], r["talk"] or 0, r["segment"] or 0, r["start_s"], r["end_s"], r["confidence"]) for r in M.detect_boundaries(*args).collect())
    assert got == [
        ("matched", 1, 0, 100.0, 640.0, "high"), ("matched", 2, 0, 700.0, 1240.0, "medium"), ("matched", 3, 0, 1300.0, 1900.0, "medium"),
        ("open segment", 0, 4, 8000.0, 8100.0, None), ("open talk", 5, 0, None, None, None), ("unverifiable", 4, 0, 0.0, None, "unverifiable"),
    ]
