"""Documents rebuilt by the stream in any order equal those of a batch over all commits."""

import json
import random


from spanloom.streaming import rebuild as R

COMMITS = "uri string, collection string, operation string, time_us long, rev string, record string"


def commits(n=12):
    rng, rows, clock = random.Random(3), [], 0
    put = lambda uri, kind, record, op="update": rows.append((uri, f"x.{kind}", op, (clock := len(rows)) + 1, f"r{clock}", None if record is None else json.dumps(record)))
    for e in range(n):
        key = f"e{e}"
        put(key, "expression", {"text": f"text {e}"})
        for c in range(1 + e % 2):
            tokens = [[i, 3 * i, 3 * i + 2] for i in range(4 * c, 4 * c + 4)]
            rng.shuffle(tokens)
            put(f"{key}/s{c}", "segmentation", {"expression": key, "tokens": tokens, "times": [[i, 100 * i, 100 * i + 50] for i in range(4 * c + 1, 4 * c + 4)]})
        for kind in ("ner", "topic")[: e % 3]:
            put(f"{key}/{kind}", "annotationLayer", {"expression": key, "subkind": kind, "annotations": [{"kind": kind, "byteStart": 1, "byteEnd": 5, "value": f"old {e}"}]})
            put(f"{key}/{kind}", "annotationLayer", {"expression": key, "subkind": kind, "annotations": [{"kind": kind, "byteStart": e, "byteEnd": e + 5, "value": f"v{e}"}]})
    put("e1", "expression", None, "delete")
    put("e4/ner", "annotationLayer", None, "delete")
    put("e9", "other", {"text": "no part"})
    return rows


def test_any_order_equals_the_batch(spark, tmp_path):
    rows = commits()
    known = spark.createDataFrame([("e4/ner", "e4")], "uri string, expression string")
    all_ = spark.createDataFrame(rows, COMMITS)
    want = sorted(map(repr, R.documents_of(all_, known).collect()))
    assert [r["expression"] for r in R.documents_of(all_, known).orderBy("expression").collect()] == ["e10", "e11", "e2", "e5", "e7", "e8"]
    for order in range(2):
        mixed = rows + rows[::3]
        random.Random(order).shuffle(mixed)
        source, out = f"{tmp_path}/in{order}", f"{tmp_path}/out{order}"
        for k in range(3):  # three runs over one checkpoint
            spark.createDataFrame(mixed[k::3], COMMITS).coalesce(1).write.mode("append").parquet(source)
            stream = R.rebuild_stream(spark.readStream.schema(COMMITS).parquet(source), known)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c{order}").trigger(availableNow=True).start().awaitTermination()
        got = R.newest_documents(spark.read.parquet(out))
        assert sorted(map(repr, got.collect())) == want


def test_document_of_records(spark):
    doc = {r["expression"]: r for r in R.documents_of(spark.createDataFrame(commits(), COMMITS)).collect()}["e2"]
    assert doc["text"] == "text 2"
    # token 0 has no time
    assert [tuple(f) for f in doc["facets"]] == [(2, 7, "ner", "v2"), (2, 7, "topic", "v2"), (3, 5, "timestamp", "100000000-150000000"), (6, 8, "timestamp", "200000000-250000000"), (9, 11, "timestamp", "300000000-350000000")]
    assert R.documents_of(spark.createDataFrame([], COMMITS)).count() == 0
