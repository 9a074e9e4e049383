"""Steps that shuffle words once, or not at all, and give the same rows as pairs by brute force."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions.timing import word_lists, words_table
from spanloom.operators import boundaries as B
from spanloom.operators import sequence as S
from spanloom.operators import spans as P
from spanloom.operators import transitions as T
from spanloom.plans import adapters as A
from tests.conftest import SF

WORDS = "doc_id long, pos int, word string, start_ms long, end_ms long"


def planned(rows):
    """The plan, to be asked for before the rows are."""
    return rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")


@pytest.fixture
def shuffled(spark):
    """No join is broadcast, so each side that a join needs by key is an exchange in the plan."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield lambda rows: planned(rows).count("Exchange hashpartitioning")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_gaps_are_shuffled_once(spark, shuffled):
    """Gaps of one time keep their own words; talks of one number too."""
    gaps = spark.createDataFrame([("s", 100.0, ["grace"], ["bridges"]), ("s", 100.0, ["tony"], ["scale", "bridges"]), ("s", 9000.0, ["grace"], [])], "stream string, at_s double, before array<string>, after array<string>")
    talks = spark.createDataFrame([("s", "a", "Bridges scale", ["Grace Oh"], 150.0), ("s", "a", "Bridges scale", ["Grace Oh"], 8500.0), ("s", "b", None, ["Tony Xu"], 150.0), ("t", "c", "x", ["Grace"], 1.0)], "stream string, talk string, title string, speakers array<string>, due_s double")
    rows = T.score_gap_talk_pairs(gaps, talks, 1000.0, F.upper)
    assert sum("array_join(_words" in x.partition("Exchange")[0] for x in planned(rows).split("Exchange ")) == 1
    assert sorted((r["talk"], r["at_s"], r["bonus"]) for r in rows.collect()) == [("a", 100.0, 6), ("a", 100.0, 10), ("a", 9000.0, 10), ("b", 100.0, 10)]


def test_words_in_zones_are_shuffled_once(spark, shuffled):
    """Zones that overlap, touch, turn round and lack a place; words without times, of no length and of equal starts."""
    said = [(1, k, f"w{k}", a, b) for k, (a, b) in enumerate([(0, 5), (5, 9), (10, 10), (12, 20), (12, 13), (30, 31), (None, None), (40, 60)])]
    said += [(2, 0, "x", 0, 5), (None, 0, "y", 0, 5)]
    cuts = [(1, 5, 7), (1, 9, 11), (1, 6, 6), (1, 13, 30), (1, 55, 50), (1, None, 99), (3, 0, 9), (None, 0, 9)]
    words = spark.createDataFrame(said, WORDS)
    zones = spark.createDataFrame(cuts, "doc_id long, start_ms long, end_ms long")
    new = spark.createDataFrame([(1, "new", 12, 12), (3, "new", 1, 2)], "doc_id long, word string, start_ms long, end_ms long")
    rows = S.replace_in_zones(words, zones, new)
    assert shuffled(rows) == 1
    over = lambda w, z: None not in (w[0], *w[3:], *z) and w[0] == z[0] and w[3] < z[2] and w[4] > z[1]
    kept = [(w[0], 0, w[1], w[2]) for w in said if not any(over(w, z) for z in cuts)]
    got = [(r["doc_id"], r["word"]) for r in rows.collect()]
    assert sorted(got, key=str) == sorted([*[(k[0], k[3]) for k in kept], (1, "new"), (3, "new")], key=str)
    assert [r["word"] for r in rows.where("doc_id = 1").orderBy("pos").collect()] == ["w6", "w0", "w4", "new", "w5"]


def test_streamed_words_need_no_python(spark):
    rows = A.streamed_words(spark, SF, 3.0, 1.5)
    assert "MapInArrow" not in planned(rows)
    assert rows.select("word").exceptAll(A.words(spark, SF).select("word")).count() == 0 and rows.count() == A.words(spark, SF).count()


def test_only_words_near_pauses_are_joined(spark, shuffled):
    text, times = " ".join("abcdefgh"), [0, 5, 0, 5, 3000, 5, 0, 5, 0, 5, 2500, 5, 0, 5, 2000, 5]
    docs = spark.createDataFrame([(1, text, 0, times, "pairs"), (2, "a", 0, [0, 5], "pairs"), (3, None, 0, [], "pairs")], "doc_id long, text string, start_ms long, timings array<long>, encoding string")
    sentences = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 7), (1, 2, 8, 13), (1, 3, 14, 15), (2, 0, 0, 1)], "doc_id long, ordinal long, byte_start long, byte_end long")
    rows = B.paragraph_breaks(word_lists(docs), sentences, within=1)
    assert planned(rows).count("MapInArrow") == 1
    want = [(1, 0, 0, 1), (1, 1, 2, 7), (1, 2, 8, 13), (1, 3, 14, 15), (2, 0, 0, 1)]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, B.paragraph_breaks(words_table(docs), sentences, within=1).collect())) == want


def test_words_under_spans_are_shuffled_once(spark, shuffled):
    """Spans of one kind may overlap and lie in any order; the first by number that holds the word counts."""
    words = spark.createDataFrame([(d, k, 10 * k, 10 * k + 9) for d in (1, 2) for k in range(30)] + [(3, 0, None, None)], "doc_id long, pos int, byte_start long, byte_end long")
    spans = "doc_id long, ordinal int, byte_start long, byte_end long"
    a = [(1, k, 290 - 20 * k, 330 - 20 * k) for k in range(15)] + [(1, 99, 0, 299)]
    b = [(1, 5, 0, 100), (1, 2, 50, 299), (2, 1, 3, 8), (2, 0, 9, 9)]
    rows = P.span_hierarchy(words, spark.createDataFrame(a, spans), spark.createDataFrame(b, spans), size=64)
    assert shuffled(rows) == 2  # words, and spans of both kinds
    first = lambda w, xs: min([x[1] for x in xs if x[0] == w["doc_id"] and w["byte_start"] is not None and x[2] <= w["byte_start"] and x[3] >= w["byte_end"]], default=-1)
    want = sorted((w["doc_id"], w["pos"], first(w, a), first(w, b)) for w in words.collect())
    assert sorted(map(tuple, rows.collect())) == want
