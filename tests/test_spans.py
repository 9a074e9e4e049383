"""Round trips of spans and files, and post classes."""

import json
import tempfile

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.timing import text_words
from spanloom.operators import align, spans
from spanloom.plans import adapters as A
from spanloom.sources import files
from tests.conftest import SF


def test_layers_route_equals_direct_route(spark):
    w = A.words(spark, SF).where("doc_id < 20")
    notes = spark.createDataFrame([(1, 0, 5, "A", None, "c1"), (1, 6, 9, "B", "did:x", "c2"), (2, 0, 2, "C", None, None)], "doc_id long, byte_start long, byte_end long, label string, speaker_did string, concept_uri string")
    extra = spans.entity_spans(notes).unionByName(spans.break_spans(spark.createDataFrame([(1, 7)], "doc_id long, byte_start long")))
    direct = spans.timestamp_spans(w).unionByName(extra)
    layered = spans.layers_to_spans(spans.token_layers(w, 50), extra)
    texts = w.select("doc_id").distinct()
    key = lambda df: sorted(map(repr, spans.extract_document(spans.assemble_documents(texts, df)).collect()))
    assert key(direct) == key(layered)
    assert {r["kind"] for r in extra.collect()} == {"concept-ref", "speaker-ref", "entity", "topic-break"}


def test_hierarchy(spark):
    w = text_words(spark.createDataFrame([(1, "a b c d e")], "doc_id int, text string"))
    s = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 7)], "doc_id int, ordinal int, byte_start int, byte_end int")
    p = spark.createDataFrame([(1, 0, 0, 9)], s.schema)
    got = [(r["sentence"], r["paragraph"]) for r in spans.span_hierarchy(w, s, p, size=4).orderBy("pos").collect()]
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (-1, 0)]


def test_chunk_text(spark):
    text = "One two. Three four? " + "x" * 30 + " end! Last one."
    rows = spans.chunk_text(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), 22).orderBy("doc_id", "chunk").collect()
    got = [r["text"] for r in rows if r["doc_id"] == 1]
    assert got[0] == "One two. Three four?" and all(len(x) <= 22 for x in got) and "".join(got).replace(" ", "") == text.replace(" ", "")
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [""]


def test_zones(spark):
    said = [("s", i, "0", 1.0 * i, i + 0.5) for i in range(25)] + [("s", 30 + i, w, 100.0 + i, 100.5 + i) for i, w in enumerate(("thank you for watching " * 3).split())]
    words = spark.createDataFrame(said, "stream string, pos int, word string, start_s double, end_s double")
    di = spark.createDataFrame([("s", 1, 0.0, 20.0, "a"), ("s", 2, 200.0, 210.0, "a")], "stream string, event_id int, start_s double, end_s double, speaker string")
    got = spans.zones_of(words, di).collect()
    # the words in the silence reach from the zero loop to the phrases
    assert [(r["start_s"], r["end_s"], r["pattern"]) for r in got] == [(0.0, 111.5, "numeric zero loop; diarization silence mismatch; Thank you for watching")]


def test_transcript_files(spark):
    folder = tempfile.mkdtemp()
    json.dump({"text": "a b", "startMs": 5, "timings": [100, -50, 100]}, open(f"{folder}/one.json", "w"))
    json.dump({"words": [{"word": "x", "start": 1.0, "end": 1.3}, {"word": "y", "start": 3.3, "end": 3.6}]}, open(f"{folder}/two.json", "w"))
    got = {r["doc_id"]: (r["text"], r["start_ms"], r["timings"]) for r in files.read_transcript_files(spark, folder).collect()}
    assert got == {"one": ("a b", 5, [100, -50, 100]), "two": ("x y", 1000, [300, -2000, 300])}
    out = tempfile.mkdtemp()
    files.write_annotations(spark.createDataFrame([("k1", 1), ("k2", 2)], "doc_id string, n int"), f"{out}/a")
    assert spark.read.json(f"{out}/a").count() == 2
    json.dump({"rkeyToCanonical": {"a": "b", "c": "b"}}, open(f"{out}/m.json", "w"))
    assert {(r["key"], r["value"]) for r in files.read_sidecar_map(spark, f"{out}/m.json", "rkeyToCanonical").collect()} == {("a", "b"), ("c", "b")}


def test_posts(spark):
    rows = [(1, "I wrote this", ["https://my.blog/x"]), (2, "see", ["https://v.tube.example/1", "https://a.b"]), (3, "recap", ["https://v.tube.example/2"]), (4, "hi", []), (5, "a blog", ["https://home.example/p", "https://z.y/q"])]
    df = spark.createDataFrame(rows, "i int, text string, links array<string>")
    kind = T.classify_post(F.col("text"), F.col("links"), ["tube.example"])
    got = [tuple(r) for r in df.select("i", kind.alias("k"), "links").select("i", "k", T.primary_url(F.col("k"), F.col("links"), ["tube.example"], "home.example")).orderBy("i").collect()]
    assert got == [(1, "blog", "https://my.blog/x"), (2, "video", "https://v.tube.example/1"), (3, "video", "https://v.tube.example/2"), (4, "post", None), (5, "blog", "https://z.y/q")]
