"""The registered pairs of titles: all pairs of rows, copies too."""

from pyspark.sql import functions as F

from spanloom.plans import registry


def test_registered_pairs_are_of_rows(spark, tmp_path):
    """Forty copies of one text: the query has their pairs, not one for the class."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["title_pairs"](spark, str(tmp_path))
    assert rows.columns == ["uri", "place", "vod_uri", "vod_place", "score"]
    ratio = lambda t, v: (300 + v % 11 * 400) / (600 + t % 7 * 300)
    wanted = {(t, v + 1_000_000, 1.0 if v % 3 == 0 else 0.9 if v % 3 == 1 else 0.5) for t in range(40) for v in range(40) if 0.3 <= ratio(t, v) <= 2.5}
    got = [(r["uri"], r["vod_uri"], r["score"]) for r in rows.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
