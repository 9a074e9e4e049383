"""Sentences' places made in the text's row: those of ``sentence_rows``, without a shuffle."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import sequence as S


def test_places_are_those_of_the_rows(spark):
    rng = random.Random(8)
    parts = ["Ada", "über", "ends.", "Why?", "so!", " ", "  ", "\t", "\n", "\x0b", " ", "e.g.", ".", "...", "日本。", "x"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, ""), (401, None), (402, " . ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    number = (F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1).cast("long")
    wanted = S.sentence_rows(docs).select("doc_id", number.alias("ordinal"), "byte_start", "byte_end")
    got = S.sentence_places(docs)
    assert "Exchange" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 500
