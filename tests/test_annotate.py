"""All layers of one document, and words replaced in zones: known answers."""

from spanloom.operators import sequence as S
from spanloom.operators.annotate import annotate_documents


def test_layers_of_a_document(spark):
    text = "Ada spoke.  Then the big dog\nran. It ran on. Ada left."
    n = len(text.split())
    timings = [x for i in range(n) for x in ((3000 if i == 6 else 0), 100)]
    docs = spark.createDataFrame([(1, text, 0, timings, "pairs"), (2, " ", 0, [], "pairs"), (3, None, 0, None, "pairs")], "doc_id long, text string, start_ms long, timings array<long>, encoding string")
    names = spark.createDataFrame([("ADA", "c:ada"), ("big dog", "c:dog"), ("dog", "c:d")], "term string, uri string")
    people = spark.createDataFrame([("ada", "did:ada")], "term string, uri string")
    proposals = spark.createDataFrame([(1, 0, "dog ran", None, False), (1, 1, "then", "Dog", True), (1, 2, "left", None, True), (1, 3, "ran on", None, False)], "doc_id long, place int, phrase string, label string, is_new boolean")
    vectors = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for i in range(6)], "doc_id long, ordinal long, vector array<double>")
    flat = " ".join(text.split())
    rows = annotate_documents(docs, names, people, proposals, vectors).collect()
    got = {}
    for r in rows:
        assert r["doc_id"] == 1
        got.setdefault(r["subkind"], []).append((flat.encode()[r["byte_start"] : r["byte_end"]].decode(), r["features"]))
    said = {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()}
    assert [t for t, _ in said["sentence-boundary"]] == ["Ada left.", "Ada spoke.", "It ran on.", "Then the big dog ran."]
    # the pause before "ran." is nearest to the sentence after it
    assert [t for t, _ in said["paragraph-boundary"]] == ["Ada spoke. Then the big dog ran.", "It ran on. Ada left."]
    person, dog = {"nerType": "PERSON", "speakerDid": "did:ada"}, {"nerType": "CONCEPT", "conceptUri": "c:dog"}
    assert said["ner"] == [("Ada", person), ("Ada", person), ("Then", {"nerType": "CONCEPT", "conceptUri": "c:d"}), ("big dog", dog), ("ran on", {"nerType": "CONCEPT"})]
    assert annotate_documents(docs.where("doc_id > 1"), names).count() == 0


def test_replace_in_zones(spark):
    words = spark.createDataFrame([("d", i, f"w{i}", 100 * i, 100 * i + 90) for i in range(8)], "doc_id string, pos int, word string, start_ms long, end_ms long")
    zones = spark.createDataFrame([("d", 190, 400), ("d", 650, 660), ("e", 0, 9)], "doc_id string, start_ms long, end_ms long")
    new = spark.createDataFrame([("d", "b", 300, 350), ("d", "a", 200, 290), ("d", "c", 700, 705), ("e", "x", 1, 2)], "doc_id string, word string, start_ms long, end_ms long")
    got = [(r["doc_id"], r["pos"], r["word"]) for r in S.replace_in_zones(words, zones, new).orderBy("doc_id", "pos").collect()]
    # w1 ends where the zone begins; w4 begins where it ends
    assert got == [*[("d", i, w) for i, w in enumerate(["w0", "w1", "a", "b", "w4", "w5", "w7", "c"])], ("e", 0, "x")]
