"""The stream's result equals the batch result, whatever the order of arrival."""

import json
import random
import tempfile

from spanloom.sources import records
from spanloom.streaming import commits as C


def line(n, uri, op, t, collection="c.talk", did="did:a", **record):
    return json.dumps({"did": did, "kind": "commit", "time_us": t, "commit": {"operation": op, "collection": collection, "rkey": uri, "rev": f"r{n:04d}", "record": record or None}})


def events():
    rng = random.Random(0)
    out = [line(i, f"k{rng.randrange(12)}", rng.choice(["create", "update", "update", "delete"]), 1000 + i, x=i) for i in range(80)]
    return out


def write(folder, name, lines):
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines))


def run(spark, files):
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    snap = C.CommitLog(spark, f"file://{out}/talks")
    for k, lines in enumerate(files):
        write(src, f"{k}.json", lines)
        q = C.stream_index(C.commit_stream(spark, src, 1), snap, f"{out}/cp", ["c.talk"])
        q.awaitTermination()
    return sorted((r["uri"], r["time_us"], r["record"]) for r in C.live(snap.read()).collect()), snap


def test_stream_equals_batch_in_any_order(spark):
    lines = events()
    batch = records.parse_commit_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    want = sorted((r["uri"], r["time_us"], r["record"]) for r in records.latest_state(batch).collect())
    mixed = random.Random(1).sample(lines, len(lines))
    assert run(spark, [lines[:30], lines[30:]])[0] == want
    got, snap = run(spark, [mixed[:50], mixed[50:]])
    assert got == want
    state = sorted(map(tuple, snap.read().collect()), key=str)
    folded = snap.compact(f"{snap.root}-folded")
    assert sorted(map(tuple, folded.read().collect()), key=str) == state
    snap.write(batch.limit(0), 1)
    assert snap.read().count() <= len(state)


def test_bad_lines_and_routes(spark):
    rows = [("{bad",), ('{"did": 1}',), (line(1, "a", "create", 5),), (line(2, "b", "create", 6, collection="x.layer", did="did:b"),), ('{"kind":"commit","did":"d","time_us":null}',)]
    got = records.parse_commit_events(spark.createDataFrame(rows, "value string"))
    assert {r["rkey"] for r in got.collect()} == {"a", "b"}
    routed = records.route_commits(got, ["c.talk", "x.layer"], ["x.layer"], "did:a")
    assert {r["rkey"] for r in routed.collect()} == {"a"}
    assert records.stream_max_age(got, 6 + 72 * 3_600_000_000).count() == 1


def test_expressions_and_cascades(spark):
    rows = [
        ("at://d/p.expression/1", "p.expression", "{}"),
        ("at://d/p.segmentation/1", "p.segmentation", '{"expression": "at://d/p.expression/1"}'),
        ("at://d/p.annotationLayer/1", "p.annotationLayer", '{"expression": "at://d/p.expression/1"}'),
        ("at://d/p.expression/2", "p.expression", "{}"),
        ("at://d/p.expression/3", "p.expression", None),
    ]
    state = spark.createDataFrame(rows, "uri string, collection string, record string")
    keys = C.affected_expressions(state)
    assert {r["uri"][-1] for r in keys.collect()} == {"1", "2", "3"}
    assert [r["uri"][-1] for r in C.ready_expressions(state, keys).collect()] == ["1"]
    children = spark.createDataFrame([(1, "at://d/p.expression/3"), (2, "at://d/p.expression/1"), (3, "at://d/none")], "id int, parent string")
    assert {r["id"] for r in C.with_cascades(children, state, "parent").collect()} == {2, 3}


def test_read_records(spark):
    folder = tempfile.mkdtemp()
    write(folder, "a.json", [json.dumps({"uri": "at://did:x/c.talk/k1", "value": {"title": "t"}}), "nonsense"])
    r = records.read_records(spark, folder, "c.talk").collect()
    assert [(x["did"], x["rkey"], json.loads(x["record"])) for x in r] == [("did:x", "k1", {"title": "t"})]
    assert records.as_commit_events(records.read_records(spark, folder, "c.talk")).first()["operation"] == "create"
