"""Edits replayed: known answers, and random logs against a plain loop over a list."""

import random

from spanloom.operators import edits as E

TALKS = "stream string, talk string, title string, start_s double, end_s double, confidence string"


def test_replay(spark):
    talks = spark.createDataFrame([("s", "a", "A", 0.0, 100.0, "high"), ("s", "b", "B", 100.0, 200.0, "low")], "stream string, talk string, title string, start_s double, end_s double, confidence string")
    log = [
        ("s", 1, "move", "a", "end", 90.0, None, None), ("s", 2, "split", "b", None, 150.0, None, "c"), ("s", 3, "add", "d", None, 95.0, 99.0, "New"),
        ("s", 4, "verify", "a", None, None, None, None), ("s", 5, "title", "c", None, None, None, "C"), ("s", 6, "remove", "b", None, None, None, None),
        ("s", 7, "unverify", "a", None, None, None, None), ("s", 8, "name", "SPEAKER_1", None, None, None, "Ann"), ("s", 9, "name", "SPEAKER_1", None, None, None, "Bea"),
    ]
    edits = spark.createDataFrame(log, E.EDIT_SCHEMA)
    got = [tuple(r)[2:] for r in E.replay_corrections(talks, edits).orderBy("place").collect()]
    assert got == [("a", "A", 0.0, 90.0, "high", False), ("d", "New", 95.0, 99.0, "manual", False), ("c", "C", 150.0, 200.0, "low", False)]
    part = [tuple(r)[2:4] for r in E.replay_corrections(talks, edits, 2).orderBy("place").collect()]
    assert part == [("a", "A"), ("b", "B"), ("c", "Untitled")]
    assert E.speaker_names(edits).first()["name"] == "Bea"


def plain(talks, log):
    rows = [dict(talk=t, title=n, start=a, end=b, conf=c, ok=False, birth=-1) for t, n, a, b, c in sorted(talks, key=lambda t: (t[2], t[0]))]
    for _, seq, kind, talk, edge, at, end, text in sorted(log, key=lambda e: e[1]):
        own = [r for r in rows if r["talk"] == talk]
        if kind == "move" and own:
            own[0]["start" if edge == "start" else "end"] = at
        elif kind == "split" and own:
            k = rows.index(own[0])
            rows.insert(k + 1, dict(own[0], talk=text, title="Untitled", start=at, ok=False, birth=seq))
            rows[k]["end"] = at
        elif kind == "add":
            rows.append(dict(talk=talk, title=text, start=at, end=end, conf="manual", ok=False, birth=seq))
            rows.sort(key=lambda r: r["start"])
        elif kind == "remove":
            rows = [r for r in rows if r["talk"] != talk]
        elif kind == "title" and own:
            own[0]["title"] = text
        elif kind in ("verify", "unverify") and own:
            own[0]["ok"] = kind == "verify"
    return [(i + 1, r["talk"], r["title"], r["start"], r["end"], r["conf"], r["ok"]) for i, r in enumerate(rows)]


def test_replay_equals_a_plain_loop(spark):
    rng, base, log, want, short = random.Random(5), [], [], {}, {}
    clock = iter(rng.sample(range(100_000), 50_000))
    for s in range(12):
        name = f"s{s}"
        talks = [(f"t{k}", f"T{k}", float(next(clock)), float(next(clock)), "high") for k in range(s % 5 + 1)]
        known, edits = [t[0] for t in talks], []
        for seq in range(1, 40 if s else 1):
            kind = rng.choice(["move", "split", "split", "add", "remove", "title", "verify", "unverify"] if s % 3 else ["move", "split", "title"])
            talk = rng.choice(known[-6:]) if kind != "add" else f"a{seq}"
            text = f"n{seq}"
            if kind == "add":
                known.append(talk)
            if kind == "split":
                known.append(text)
            edits.append((name, seq, kind, talk, rng.choice(["start", "end"]), float(next(clock)), float(next(clock)), text))
        base += [(name, *t) for t in talks]
        log += edits
        want[name], short[name] = plain(talks, edits), plain(talks, edits[:15])
    rng.shuffle(log)
    args = spark.createDataFrame(base, TALKS), spark.createDataFrame(log, E.EDIT_SCHEMA)
    for cursor, answer in ((None, want), (15, short)):
        got = {s: [] for s in answer}
        for r in E.replay_corrections(*args, cursor).orderBy("stream", "place").collect():
            got[r["stream"]].append(tuple(r)[1:])
        assert got == answer
