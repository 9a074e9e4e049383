"""Steps that several parts of a query read are made once; plain words are cleaned as all others."""

from pyspark.sql import functions as F

from spanloom.functions.text import clean_token
from spanloom.operators import catalog, index


def test_bigram_pmi_reads_stored_counts(spark):
    docs = spark.createDataFrame([(1, "blue gardens grow near blue gardens"), (2, "blue gardens, stone bridges"), (3, "stone bridges"), (None, None)], "doc_id long, text string")
    rows = index.bigram_pmi(docs, least_pmi=0.0)
    assert {f.rsplit("/", 2)[-2].split("-")[0] for f in rows.inputFiles()} == {"pairs", "singles"}
    assert {(r["term"], r["n"], r["n_docs"]) for r in rows.collect()} == {("blue gardens", 3, 2), ("stone bridges", 2, 2)}


def test_bigram_entries_without_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([(1, 0, "Blue", 5), (1, 1, "gardens!", 9), (2, 0, "blue", 3), (2, 1, "'gardens", 4), (2, 2, "x", 8)], "doc_id long, pos int, word string, start_ms long")
    pairs = spark.createDataFrame([("blue gardens",), ("blue gardens",), ("no pair",)], "term string")
    for most in (10, 0):
        monkeypatch.setattr(index, "MOST_BROADCAST", most, raising=False)
        assert list(map(tuple, index.bigram_entries(words, pairs).collect())) == [("blue gardens", 2, 2, 3)]


def test_clean_token_of_plain_words(spark):
    said = ["Word", "42", "it's", "'tis", "well-known-", "Ünder", "line\n", "s", "", None]
    rows = spark.createDataFrame([(w,) for w in said], "w string").select(clean_token(F.col("w"))).collect()
    assert [r[0] for r in rows] == ["word", "42", "it", "tis", "well-known", "nder", "line", "s", "", None]


def test_enrich_index_reads_stored_steps(spark):
    entries = spark.createDataFrame([("ring", False, k, 1) for k in range(4)], "term string, proper boolean, talk long, n long")
    concepts = spark.createDataFrame([(1, "Red Ring", ["band"])], "uri long, name string, aliases array<string>")
    talks = spark.createDataFrame([(1, 0), (1, 2)], "concept_uri long, talk long")
    rows = catalog.enrich_index(entries, concepts, talks)
    assert {"entries", "shared", "subentries"} <= {f.rsplit("/", 2)[-2].split("-")[0] for f in rows.inputFiles()}
    assert {(r["role"], r["label"], tuple(r["talks"]), r["n"]) for r in rows.collect()} == {("entry", None, (1, 3), 4), ("subentry", "Red Ring", (0, 2), 2)}
