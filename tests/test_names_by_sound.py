"""Names heard by sound: names of the same parts and a name_id with several names."""

from pyspark.sql import functions as F

from spanloom.operators import boundaries as B


def test_each_name_gets_each_word_once(spark):
    names = spark.createDataFrame([(1, "Ada Adam"), (2, "adam  ADA"), (3, "Grace"), (3, "Ada"), (4, None), (5, "Li")], "name_id int, name string")
    words = spark.createDataFrame([(w,) for w in ("Ada,", "ada", "adapt", "grace", "oda", "li", "", "bee")], "word string")
    got = sorted(tuple(r) for r in B.phonetic_name_join(names, words, F.upper).collect())
    heard = ["ada", "adapt", "oda"]
    assert got == sorted([(k, w) for k in (1, 2, 3) for w in heard] + [(3, "grace")])


def test_words_are_read_once_and_pairs_of_names_are_not_shuffled(spark):
    names = spark.range(500).select(F.col("id").alias("name_id"), F.lit("Ada Lovelace").alias("name"))
    words = spark.createDataFrame([("ada",), ("adapt",)], "word string")
    rows = B.phonetic_name_join(names, words, F.upper)
    assert rows.count() == 1000 and rows.distinct().count() == 1000
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the result itself isn't made distinct: above the last join there is no aggregate
    assert plan.index("Join") < plan.index("Aggregate")
