"""Words as one list a text: the same results as rows of words, without a shuffle of words, which are read once."""

from pyspark.sql import functions as F

from spanloom.functions.timing import word_lists, words_table
from spanloom.operators import matching as M
from spanloom.operators import sequence as S
from spanloom.operators import transitions as T


def transcripts(spark):
    rows = [(1, "a b c d", 5, [0, 10, 40, 20, 0, 5, 0, 5], "pairs"), (2, None, 0, [], "signed"), (3, "été x  y", 7, [10, -30, 20], "signed"), (4, "", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start_ms long, timings array<long>, encoding string")


def plan(rows):
    return rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")


def test_lists_hold_the_words_of_the_table(spark):
    lists = word_lists(transcripts(spark))
    assert lists.count() == 4
    flat = lists.select("doc_id", F.explode("ws").alias("w")).select("doc_id", "w.*")
    assert flat.schema.names == words_table(transcripts(spark)).schema.names
    assert sorted(map(str, flat.collect())) == sorted(map(str, words_table(transcripts(spark)).collect()))


def test_gaps_of_lists_need_no_shuffle(spark):
    rows = S.gap_context(word_lists(transcripts(spark)), 30)
    assert "Exchange" not in plan(rows)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, S.gap_context(words_table(transcripts(spark)), 30).collect())) == [(1, 1, 40, "a", "b c d"), (3, 1, 30, "été", "x y")]


def test_starts_refined_from_lists(spark):
    said = [("s", i, w, 120.0 + i, 120.8 + i) for i, w in enumerate("hello everyone I am greyce".split())] + [("s", 9, "late", 900.0, 901.0)]
    words = spark.createDataFrame(said, "stream string, pos int, word string, start_s double, end_s double")
    starts = spark.createDataFrame([("s", "a", 101.0, ["Grace Oh"])], "stream string, talk string, at_s double, speakers array<string>")
    lists = S.listed(words, "stream", ["word", "start_s", "end_s"])
    assert T.refine_start(lists, starts).collect() == T.refine_start(words, starts).collect()
    assert [r["signal"] for r in T.refine_start(lists, starts).collect()] == ["greeting+speaker"]


def test_heard_parts_stay_with_their_row(spark):
    """Rows of equal keys keep their own words; a name that sounds like many words adds one part to a row, not the words."""
    rows = spark.createDataFrame([("s", 1.0, ["gracea", "graceb"]), ("s", 1.0, ["tony"]), ("t", 1.0, [])], "stream string, at_s double, said array<string>")
    parts = spark.createDataFrame([("s", "a", "grace"), ("s", "b", "tony")], "stream string, talk string, part string")
    got = T.with_heard_parts(rows, parts, ["stream", "at_s"], "said", F.upper)
    assert sorted((r["stream"], r["heard"] or []) for r in got.collect()) == [("s", ["grace"]), ("s", ["tony"]), ("t", [])]


def test_signals_read_the_words_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame([("d", i, w, 700.0 + i, 700.5 + i) for i, w in enumerate("so greyce here and my name is Alun".split())], "stream string, pos long, word string, start_s double, end_s double")
    words = words.mapInArrow(counted, words.schema)
    segments = spark.createDataFrame([("d", 2, 700.0, 1250.0, "single-speaker")], "stream string, segment long, start_s double, end_s double, kind string")
    talks = spark.createDataFrame([("d", 3, "Paper", ["Alan Wu"], 1200.0)], "stream string, talk long, title string, speakers array<string>, starts_s double")
    got = {(r["source"], r["name"]) for r in M.segment_signals(words, segments, talks).collect()}
    assert ("self-intro", "Alun") in got and ("name-scan", "Alan") in got
    assert read.value == 8


def test_layers_are_cut_and_stamped_in_place(spark):
    from spanloom.operators import spans as P

    lists, rows = word_lists(transcripts(spark)), words_table(transcripts(spark))
    noted = spark.createDataFrame([(1, "entity", 0, 1, "x"), (9, "entity", 0, 1, "y")], "doc_id long, kind string, byte_start long, byte_end long, value string")
    layers = P.token_layers(lists, 3)
    assert sorted(map(str, layers.collect())) == sorted(map(str, P.token_layers(rows, 3).collect()))
    spans = P.layers_to_spans(layers, noted)
    assert "Exchange" not in plan(spans.where("kind = 'timestamp'")) and "Join" not in plan(spans)
    texts = transcripts(spark).select("doc_id", "text")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(P.assemble_layers(texts, layers, noted)) == key(P.assemble_documents(texts, spans))


def test_tokens_meet_times_by_number(spark):
    from spanloom.operators import spans as P

    layers = spark.sql("SELECT 1L AS doc_id, 0 AS chunk, array(named_struct('pos', 0, 'byte_start', 0L, 'byte_end', 1L), named_struct('pos', 2, 'byte_start', 4L, 'byte_end', 5L)) AS tokens, array(named_struct('pos', 1, 'start_ms', 7L, 'end_ms', 8L), named_struct('pos', 2, 'start_ms', 9L, 'end_ms', 10L)) AS times")
    none = spark.createDataFrame([], "doc_id long, kind string, byte_start long, byte_end long, value string")
    assert [tuple(r) for r in P.layers_to_spans(layers, none).collect()] == [(1, "timestamp", 4, 5, "9000000-10000000")]


def test_phrases_of_one_length_share_the_joined_words(spark):
    rows = S.phrase_loop_zones(words_table(transcripts(spark)))
    assert plan(rows).count("array_join(") == len({n for _, _, n in S.LOOP_PHRASES}) == 3 + 1
    assert rows.count() == 0
