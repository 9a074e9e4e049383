"""Gaps scored with talks, chosen and refined: known answers, and the fold against a plain loop."""

import random

from pyspark.sql import functions as F

from spanloom.operators import transitions as T

TALKS = "stream string, place int, talk string, duration_s double, first_s double"


def test_assign_transitions(spark):
    talks = spark.createDataFrame([("s", k, f"t{k}", 1200.0, 100.0) for k in range(4)], "stream string, place int, talk string, duration_s double, first_s double")
    gaps = spark.createDataFrame([("s", 1500.0, 20.0), ("s", 1400.0, 3.0), ("s", 2900.0, 10.0)], "stream string, at_s double, score double")
    got = T.assign_transitions(talks, gaps).collect()
    assert [(r["talk"], r["at_s"]) for r in got] == [("t0", 100.0), ("t1", 1500.0), ("t2", 2900.0), ("t3", 100 + 3 * 1380 + 0.5 * 20 + 0.5 * 20)]
    bonus = spark.createDataFrame([("s", "t1", 1400.0, 30.0)], "stream string, talk string, at_s double, bonus double")
    assert [r["at_s"] for r in T.assign_transitions(talks, gaps, bonus).collect()][1] == 1400.0


def plain(talks, gaps, bonus):
    out, drift, plan = [], 0.0, 0.0
    for k, (place, talk, d, first) in enumerate(sorted(talks)):
        if not k:
            plan = first
            out.append((talk, plan, 0.0))
            continue
        before = sorted(talks)[k - 1][2]
        plan += before + (60 if before <= 600 else 180)
        expected, reach, best = plan + drift, max(0.6 * before, 600), (-1.0, None)
        for at, score in sorted(gaps):
            if abs(at - expected) <= reach:
                value = score + 5 * (1 - abs(at - expected) / reach) + sum(b for t, g, b in bonus if t == talk and g == at)
                if value > best[0]:
                    best = value, at
        if best[1] is None:
            out.append((talk, expected, 0.0))
        else:
            drift += 0.5 * (best[1] - out[-1][1] - before - 180)
            out.append((talk, best[1], best[0]))
    return out


def test_assign_equals_a_plain_loop(spark):
    rng = random.Random(8)
    rows, marks, extra, want = [], [], [], {}
    for s in range(12):
        talks = [(k, f"t{k}", float(rng.choice([300, 600, 900, 2400])), 50.0) for k in range(rng.randrange(1, 9))]
        gaps = [(float(a), float(rng.randrange(-3, 30))) for a in rng.sample(range(-50, 12_000), 40 * (s % 3))]
        bonus = [(f"t{rng.randrange(9)}", g[0], rng.randrange(1, 20)) for g in gaps[:20] for _ in range(2)]
        rows += [(f"s{s}", *t) for t in talks]
        marks += [(f"s{s}", *g) for g in gaps]
        extra += [(f"s{s}", *b) for b in bonus]
        want[f"s{s}"] = plain(talks, gaps, bonus)
    got = T.assign_transitions(spark.createDataFrame(rows, TALKS), spark.createDataFrame(marks, "stream string, at_s double, score double"), spark.createDataFrame(extra, "stream string, talk string, at_s double, bonus int"))
    found = {s: [] for s in want}
    for r in got.orderBy("stream", F.length("talk"), "talk").collect():
        found[r["stream"]].append((r["talk"], round(r["at_s"], 6), round(r["score"], 6)))
    assert found == {s: [(t, round(a, 6), round(v, 6)) for t, a, v in x] for s, x in want.items()}


def test_pairs_hear_names_and_titles(spark):
    gaps = spark.createDataFrame([("s", 100.0, "well now thank Greyce".split(), "some scaled bridges".split()), ("s", 5000.0, ["Grace"], ["x"]), ("s", 300.0, [], ["nothing", "bridges"])], "stream string, at_s double, before array<string>, after array<string>")
    talks = spark.createDataFrame([("s", "a", "Bridges about scale there", ["Grace Oh"], 150.0), ("s", "b", "Bridges now", ["Tony Xu"], 150.0), ("s", "c", None, None, 150.0)], "stream string, talk string, title string, speakers array<string>, due_s double")
    got = {(r["talk"], r["at_s"]): r["bonus"] for r in T.score_gap_talk_pairs(gaps, talks, 1000.0).collect()}
    # two title words within other words, and a name by its sound; one title word is none
    assert got == {("a", 100.0): 16}
    assert T.score_gap_talk_pairs(gaps.limit(0), talks).count() == 0


def test_starts_are_refined(spark):
    said = [("s", i, w, 100.0 + i, 100.8 + i) for i, w in enumerate("so that was all from me".split())]
    said += [("s", 10 + i, w, 120.0 + i, 120.8 + i) for i, w in enumerate("hello everyone I am greyce".split())]
    said += [("s", 20 + i, w, 2000.0 + i, 2000.8 + i) for i, w in enumerate("hi folks my name is Tony".split())]
    words = spark.createDataFrame(said, "stream string, pos int, word string, start_s double, end_s double")
    starts = spark.createDataFrame([("s", "a", 101.0, ["Grace Oh"]), ("s", "b", 101.0, ["Ida Xu"]), ("s", "c", 130.0, ["Ida Xu"]), ("s", "d", 1200.0, ["Tony Xu"]), ("s", "e", 120.0, None)], "stream string, talk string, at_s double, speakers array<string>")
    got = {r["talk"]: (r["start_s"], r["score"], r["signal"]) for r in T.refine_start(words, starts).collect()}
    # c: nothing of 8 or more lies after it; e: the best place is the gap itself
    assert got == {"a": (120.0, 30, "speaker-after-gap+greeting+self-intro"), "b": (120.0, 18, "greeting+self-intro"), "c": (130.0, None, ""), "d": (2000.0, 30, "speaker-after-gap+greeting+self-intro"), "e": (120.0, None, "")}
    assert T.refine_start(words.limit(0), starts).count() == 5
