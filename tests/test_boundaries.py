"""Known answers for scores, chains, edits, sound codes and concept scans."""

import pandas as pd
from pyspark.sql import functions as F

from spanloom.functions.text import phonetic_code
from spanloom.operators import boundaries as B


def test_phonetic_codes():
    words = ["Knight", "Wright", "phone", "chat", "city", "magic", "dodge", "thin", "ship", "nation", "xylo", "lamb", "back", "box", "", "123", "whale", "bag", "taxi", "rough"]
    got = phonetic_code(pd.Series(words)).tolist()
    assert got[:3] == ["NT", "RT", "PHN"]
    assert dict(zip(words, got, strict=True)) | {"Knight": "", "Wright": "", "phone": ""} == {
        "Knight": "", "Wright": "", "phone": "", "chat": "CHT", "city": "CT", "magic": "MJS", "dodge": "DJ", "thin": "THN", "ship": "SHP", "nation": "NXN",
        "xylo": "SL", "lamb": "LM", "back": "BK", "box": "BKS", "": "", "123": "", "whale": "WL", "bag": "BJ", "taxi": "TKS", "rough": "RKH",
    }


def test_names_by_sound(spark):
    names = spark.createDataFrame([(1, "Erin Smith"), (2, "Bo Li")], "name_id int, name string")
    words = spark.createDataFrame([("aaron",), ("Smyth,",), ("smithson",), ("li",), ("table",)], "word string")
    got = {(r["name_id"], r["word"]) for r in B.phonetic_name_join(names, words).collect()}
    assert got == {(1, "aaron"), (1, "smyth"), (1, "smithson")}


def score(spark, gap, before, after):
    df = spark.createDataFrame([(gap, before, after)], "g double, b string, a string")
    return df.select(B.transition_score(F.col("g"), F.col("b"), F.col("a"))).first()[0]


def test_transition_score(spark):
    assert score(spark, 70.0, "", "") == 25.0
    assert score(spark, 36.0, "", "") == 17.0
    assert score(spark, 4.0, "Thank  you all", "Hello, my name is Ann") == 2 + 3 + 4 + 5


def test_speaker_change(spark):
    df = spark.createDataFrame(
        [(1, ["a", "a"], ["b"]), (2, ["a", "a", "b"], ["b", "b", "a"]), (3, ["a", "a", "b", "c", "d"], ["a", "a", "x", "y", "z"]), (4, ["a"], ["a"]), (5, [None], ["a"])],
        "i int, b array<string>, a array<string>",
    )
    got = [r[0] for r in df.orderBy("i").select(B.speaker_change_score(F.col("b"), F.col("a"))).collect()]
    assert got == [15, 12, 8, 0, 0]


def test_score_gaps(spark):
    words = [("s", i, w, 1.0 * i + (10 if i > 2 else 0), 1.0 * i + 1 + (10 if i > 2 else 0), "x" if i <= 2 else "y") for i, w in enumerate("thank you all hello there".split())]
    asr = spark.createDataFrame([("s", 12.0, 14.0, -2.0, 0.9)], "stream string, start_s double, end_s double, avg_logprob double, no_speech_prob double")
    r = B.score_gaps(spark.createDataFrame(words, "stream string, pos int, word string, start_s double, end_s double, speaker string"), asr).collect()
    assert len(r) == 1 and (r[0]["at_s"], r[0]["gap_s"], r[0]["score"]) == (13.0, 10.0, 5 + 3 + 4 + 15 - 5)


def test_garbled(spark):
    words = [(1, i, "uh" if i % 2 else "oh", 7000 * i, 7000 * i + 500) for i in range(12)] + [(1, 12 + i, f"w{i}", 84000 + i, 84000 + i) for i in range(12)]
    r = B.garbled_until(spark.createDataFrame(words, "doc_id int, pos int, word string, start_ms long, end_ms long")).collect()
    assert len(r) == 1 and r[0]["start_ms"] == 0


def test_sound_codes_in_sql():
    """The oracle's codes on words that meet every rule, and on random ones."""
    import random

    import duckdb

    from spanloom.plans.signals import codes_sql

    dice = random.Random(5)
    words = sorted({"".join(dice.choice("abcdghiknpstwxyz'") for _ in range(dice.randint(0, 9))) for _ in range(20_000)} | {"Knight", "Wright", "Whale", "lamb", "lambs", "dodge", "dogma", "nation", "rough", "Ghost", "back", "échec"})
    con = duckdb.connect()
    rows = pd.DataFrame({"word": words})  # noqa: F841
    got = dict(con.execute(f"WITH src AS (SELECT word FROM rows){codes_sql('src', 'word', 'codes')} SELECT token, code FROM codes").fetchall())
    assert got == dict(zip(words, phonetic_code(pd.Series(words)).tolist(), strict=True))


def test_anchor_chain(spark):
    """Nearest gap within reach, ties to the earlier, bounds of the buckets, streams without gaps."""
    talks = spark.createDataFrame([("s", i, f"t{i}", d, 0.0) for i, d in enumerate([900.0, 1000.0, 500.0, 100.0])] + [("u", 0, "x", 10.0, 5.0), ("u", 1, "y", 10.0, 5.0)], "stream string, place int, talk string, duration_s double, first_s double")
    gaps = spark.createDataFrame([("s", x) for x in (0.0, 800.0, 1000.0, 2700.0, 9000.0)] + [("v", 1.0)], "stream string, at_s double")
    got = {(r["stream"], r["place"]): (r["at_s"], r["found"]) for r in B.anchor_chain(talks, gaps).collect()}
    assert got == {("s", 0): (0.0, False), ("s", 1): (800.0, True), ("s", 2): (1000.0, True), ("s", 3): (1000.0, True), ("u", 0): (5.0, False), ("u", 1): (15.0, False)}


def test_nearest_talk(spark):
    from spanloom.operators.align import nearest_talk_for_post

    talks = spark.createDataFrame([(2, "10:00", "10:30"), (1, "10:00", "10:30"), (3, "10:20", "10:25"), (4, "12:00", "12:30"), (5, None, None)], "talk int, a string, b string").selectExpr("talk", "timestamp('2024-01-01 ' || a) starts_at", "timestamp('2024-01-01 ' || b) ends_at")
    posts = spark.createDataFrame([(1, "10:05"), (2, "10:10"), (3, "10:57"), (4, "11:30"), (5, "11:56"), (6, None), (7, "10:59")], "post int, t string").selectExpr("post", "timestamp('2024-01-01 ' || t) created_at")
    assert {r["post"]: r["talk"] for r in nearest_talk_for_post(posts, talks).collect()} == {1: 1, 2: 1, 3: 1, 5: 4, 7: 1}
