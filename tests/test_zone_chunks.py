"""Chunks of speech in zones against a plain search, and many zones of times of their own."""

import random
import time

from pyspark.sql import functions as F

from spanloom.operators import sequence as S

SEGMENT, ZONE = "stream string, event_id int, start_s double, end_s double", "stream string, zone int, zone_start double, zone_end double"


def plain(zones, segments, gap, most):
    out = []
    for stream, zone, a, b in zones:
        own = sorted((s[2], s[1], max(s[2], a), min(s[3], b)) for s in segments if s[0] == stream and s[2] < b and s[3] > a)
        blocks = []
        for k, (_, _, s, e) in enumerate(own):
            if k and s - own[k - 1][3] < gap:
                blocks[-1] = (blocks[-1][0], e)
            else:
                blocks.append((s, e))
        chunks = []
        for s, e in blocks:
            if chunks and e - chunks[-1][0] <= most:
                chunks[-1] = (chunks[-1][0], e)
            else:
                chunks.append((s, e))
        out += [(stream, zone, k, s, e) for k, (s, e) in enumerate(chunks)]
    return sorted(out)


def test_chunks_as_a_plain_search_finds(spark):
    rng = random.Random(5)
    for backward in (False, True):
        length = lambda: rng.choice([0.5, 1, 2, 30]) if not backward else rng.choice([-3, 0, 1, 2, 30])  # noqa: E731, B023
        segments = [(f"s{i % 3}", 1000 - i, a := rng.randrange(400) / 2, a + length()) for i in range(150)]
        zones = [(f"s{i % 4}", i, a := rng.randrange(-20, 420) / 2, a + rng.choice([1, 20, 90]) * (-1 if backward and i % 7 == 0 else 1)) for i in range(60)]
        zones += [zones[0], (zones[0][0], 99, *zones[0][2:])]
        got = S.zone_speech_chunks(spark.createDataFrame(zones, ZONE), spark.createDataFrame(segments, SEGMENT), 5.0, 25.0)
        wanted = plain(dict.fromkeys(zones), segments, 5.0, 25.0)
        assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 40


def test_zones_of_times_of_their_own(spark):
    """20,000 zones that each hold a quarter of 40,000 segments: 200 million pairs, none of which is made."""
    zones = spark.range(20_000).select(F.lit("s").alias("stream"), F.col("id").alias("zone"), (F.col("id") / 1000).alias("zone_start"), (F.col("id") / 1000 + 1000).alias("zone_end"))
    segments = spark.range(40_000).select(F.lit("s").alias("stream"), F.col("id").alias("event_id"), (F.col("id") / 10).alias("start_s"), (F.col("id") / 10 + 1).alias("end_s"))
    t = time.time()
    got = S.zone_speech_chunks(zones, segments)
    assert got.where("chunk = 0 and start_s = zone / 1000 and end_s = zone / 1000 + 1000").count() == 20_000 and time.time() - t < 60
