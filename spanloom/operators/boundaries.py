"""Talk boundaries on long streams: gap scores, chains of starts, names by sound.

Scores are columns and joins. Gaps are chosen for talks in ``transitions``, edits
are replayed in ``edits``, names in texts are found in ``phrases``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import phonetic_code
from spanloom.sources.files import written

from .intervals import as_of

# fixed values: phrases that end or open a talk, with their weights
PHRASES_BEFORE = [(r"thank\s*you", 3), (r"round\s*of\s*applause", 4), (r"that'?s\s*(my|our)\s*time", 4), (r"any\s*questions", 2)]
PHRASES_AFTER = [
    (r"hello|hi\s+everyone|hi\s+there|hey\s+everyone", 4), (r"my\s*name\s*is", 5), (r"i'?m\s+going\s+to\s+(talk|present|show)", 4), (r"please\s*welcome", 5),
    (r"next\s*(up|speaker|talk|presentation)", 4), (r"our\s*next", 3), (r"come\s*on\s*(down|up)", 4),
]


def transition_score(gap_s: Column, before: Column, after: Column) -> Column:
    """A gap's length on a curve, and the weights of the phrases before and after it."""
    length = F.when(gap_s >= 60, 25.0).when(gap_s >= 30, 15 + (gap_s - 30) / 3).otherwise(F.least(F.lit(15.0), gap_s * 0.5))
    said = [F.when(text.rlike(f"(?i){p}"), w).otherwise(0) for text, phrases in ((before, PHRASES_BEFORE), (after, PHRASES_AFTER)) for p, w in phrases]
    for s in said:
        length = length + s
    return length


def _main(speakers: Column) -> Column:
    """The most frequent speaker of an array in order; the first seen wins ties."""
    counted = F.transform(F.array_distinct(speakers), lambda s, i: F.struct(F.size(F.filter(speakers, lambda x: x == s)).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.try_element_at(F.reverse(F.array_sort(counted)), F.lit(1))["s"]


def speaker_change_score(before: Column, after: Column) -> Column:
    """15: another main speaker and no common one; 12: another main speaker; 8: the same, but fewer than half of the
    smaller set in common; else 0. Arrays of speakers by word, nulls left out."""
    a, b = F.array_compact(before), F.array_compact(after)
    common, least = F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    known = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(~known, 0).when(_main(a) != _main(b), F.when(common == 0, 15).otherwise(12)).when(common < least * 0.5, 8).otherwise(0)


def _near_doubts(gaps: DataFrame, asr: DataFrame, around_s: float = 30.0) -> DataFrame:
    """(stream, at_s, a, b): the two parts of ``confidence_penalty``, above zero, for the gaps that have any. Gaps and
    segments meet in buckets of time."""
    size = 2 * around_s
    low, silent = F.col("avg_logprob") < -1, F.col("no_speech_prob") > 0.5
    bad = asr.where(low | silent).select("stream", "start_s", "end_s", F.coalesce(low, F.lit(False)).alias("low"), F.coalesce(silent, F.lit(False)).alias("silent"))
    bad = bad.withColumn("_bucket", F.floor(F.col("start_s") / size))
    spread = gaps.select("stream", "at_s").withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("at_s") - around_s) / size), F.floor((F.col("at_s") + around_s) / size))))
    near = spread.join(bad, ["stream", "_bucket"]).where((F.col("start_s") >= F.col("at_s") - around_s) & (F.col("end_s") <= F.col("at_s") + around_s))
    return near.groupBy("stream", "at_s").agg(F.least(F.lit(10), 3 * F.count_if("low")).alias("a"), F.least(F.lit(8), 2 * F.count_if("silent")).alias("b"))


def _penalty() -> Column:
    return (-(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))).cast("long")


def confidence_penalty(gaps: DataFrame, asr: DataFrame, around_s: float = 30.0) -> DataFrame:
    """(stream, at_s, penalty): 3 for each segment of low log-probability within ``around_s`` (10 at most) and 2 for
    each without speech (8 at most), below zero."""
    return gaps.select("stream", "at_s").join(_near_doubts(gaps, asr, around_s), ["stream", "at_s"], "left").select("stream", "at_s", _penalty().alias("penalty"))


def score_gaps(words: DataFrame, asr: DataFrame, least_s: float = 3.0, each: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """(stream, at_s, gap_s, score, before, after) of gaps in words (stream, pos, word, start_s, end_s, speaker), or in
    lists of them (stream, ws), whose structs ``each`` may make of other ones where they are needed."""
    from .sequence import with_context

    rows = with_context(words if "ws" in words.columns else words.select("stream", "pos", "word", "start_s", "end_s", "speaker"), "start_s", "end_s", least_s, 20, 30, "stream", ["start_s"], each, ["word", "speaker"])
    rows = rows.select("stream", F.col("start_s").alias("at_s"), F.col("gap").alias("gap_s"), F.array_join("past.word", " ").alias("before"), F.array_join("ahead.word", " ").alias("after"), F.array_compact("past.speaker").alias("sb"), F.array_compact("ahead.speaker").alias("sa"))
    scored = rows.withColumn("score", transition_score(F.col("gap_s"), F.col("before"), F.col("after")) + speaker_change_score(F.col("sb"), F.col("sa")))
    # gaps without doubtful segments nearby needn't be joined twice
    return scored.join(_near_doubts(rows, asr), ["stream", "at_s"], "left").select("stream", "at_s", "gap_s", (F.col("score") + _penalty()).alias("score"), "before", "after")


def first_talk_start(gaps: DataFrame, usable: DataFrame, bonus: DataFrame | None = None, within_s: float = 2700.0) -> DataFrame:
    """(stream, start_s): the best gap (stream, at_s, score) within ``within_s`` after the usable start (stream,
    usable_s), where ``bonus`` (stream, at_s, bonus) lifts a score; a plain score wins a tie with a lifted one, then the
    earlier gap; without a gap of a score above 0, the usable start."""
    rows = gaps.join(usable, "stream").where((F.col("at_s") >= F.col("usable_s")) & (F.col("at_s") < F.col("usable_s") + within_s))
    lifted = F.lit(0.0)
    if bonus is not None:
        rows, lifted = rows.join(bonus, ["stream", "at_s"], "left"), F.greatest(F.coalesce("bonus", F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"_score": F.col("score") + lifted, "_lifted": lifted > 0}).where("_score > 0")
    best = rows.groupBy("stream").agg(F.min_by("at_s", F.struct(-F.col("_score"), "_lifted", "at_s")).alias("_at"))
    return usable.join(best, "stream", "left").select("stream", F.coalesce("_at", "usable_s").alias("start_s"))


def anchor_chain(talks: DataFrame, gaps: DataFrame, near_s: float = 900.0) -> DataFrame:
    """(stream, place, talk, at_s, found): each talk (stream, place, talk, duration_s, first_s) starts at the gap nearest
    to the start before it plus that talk's length, within ``near_s`` (the earlier on ties), else just there.

    A stream's talks are folded in order; its gaps lie in buckets of ``near_s``, of which a talk looks at three.
    """
    bucket = lambda at: F.floor(at / near_s)
    g = gaps.where("at_s is not null").select("stream", F.col("at_s").cast("double").alias("at_s")).groupBy("stream", bucket(F.col("at_s")).alias("b")).agg(F.collect_set("at_s").alias("near"))
    g = g.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.struct("b", "near"))).alias("gs"))
    t = talks.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("place", "talk", F.col("duration_s").cast("double").alias("d"), F.col("first_s").cast("double").alias("f")))).alias("ts"))
    kinds = dict(talks.dtypes)
    none = F.expr("cast(array() as array<double>)")
    empty = F.expr(f"cast(array() as array<struct<place: {kinds['place']}, talk: {kinds['talk']}, at_s: double, found: boolean, d: double>>)")

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        expected = F.when(F.size(out) == 0, x["f"]).otherwise(last["at_s"] + last["d"])
        three = F.concat(*[F.coalesce(F.try_element_at("gs", bucket(expected) + k), none) for k in (-1, 0, 1)])
        close = F.filter(three, lambda a: F.abs(a - expected) <= near_s)
        best = F.try_element_at(F.array_sort(F.transform(close, lambda a: F.struct(F.abs(a - expected).alias("far"), a.alias("at")))), F.lit(1))["at"]
        found = (F.size(out) > 0) & best.isNotNull()
        return F.concat(out, F.array(F.struct(x["place"].alias("place"), x["talk"].alias("talk"), F.when(found, best).otherwise(expected).alias("at_s"), F.coalesce(found, F.lit(False)).alias("found"), x["d"].alias("d"))))

    both = t.join(g, "stream", "left")
    return both.select("stream", F.explode(F.aggregate("ts", empty, step)).alias("r")).select("stream", "r.place", "r.talk", "r.at_s", "r.found")


def phonetic_name_join(names: DataFrame, words: DataFrame, code: Callable[[Column], Column] | None = None) -> DataFrame:
    """(name_id, word): words that sound like a part of a name. Codes are made for distinct tokens of three letters or
    more; three equi-joins: equal codes; equal first three characters; equal after different leading vowels. ``code``
    makes a code of a token, the phonetic one by default.

    Names of the same parts are settled once; only the last join, which needs no ``distinct``, has a row for each
    name_id and word, as the result has."""

    @F.pandas_udf("string")
    def coded(column):
        return phonetic_code(column)

    def table(rows: DataFrame, token: str, prefix: str) -> DataFrame:
        one = rows.select(token).distinct().where(F.length(token) >= 3).withColumn(prefix, (code or coded)(F.col(token)))
        return one.where(F.length(prefix) > 0)

    split = F.split(F.lower("name"), r"\s+")
    named = names.where("name is not null").groupBy("name_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(split)))).alias("_parts"))
    groups = named.select("_parts").distinct()
    parts = groups.select("_parts", F.explode("_parts").alias("part"))
    said = words.select("word").distinct().select(F.regexp_replace(F.lower("word"), "[^a-z'-]", "").alias("word")).distinct()
    # three joins read both, so words are read, cleaned and coded once
    a, b = table(parts, "part", "ca").where("length(ca) >= 2"), written(table(said, "word", "cb"), "coded")
    vowel = "[AEIOU]"
    same = a.join(b, F.col("ca") == F.col("cb"))
    start = a.where("length(ca) >= 3").join(b.where("length(cb) >= 3"), F.substring("ca", 1, 3) == F.substring("cb", 1, 3))
    tail = a.where(F.col("ca").rlike(f"^{vowel}")).join(b.where(F.col("cb").rlike(f"^{vowel}") & (F.length("cb") >= 2)), F.expr("substring(ca, 2) = substring(cb, 2)"))
    pairs = same.union(start).union(tail).select("part", "word").distinct()
    heard = parts.join(pairs, "part").select("_parts", "word").distinct()
    return named.join(heard, "_parts").select("name_id", "word")


def nearest_snap(targets: DataFrame, asked: DataFrame, radius_s: float = 3.0) -> DataFrame:
    """(stream, asked_s, at_s, priority): the target within ``radius_s`` by priority, then distance, then time.

    Only the targets next before and after an asked time count, of each priority that its stream has (a few ranks): two
    as-of joins, however dense the targets lie."""
    keys = ["stream", "priority"]
    points = asked.select("stream", "asked_s").distinct().join(targets.select(*keys).distinct(), "stream")
    sides = as_of(points, targets.select(*keys, F.col("at_s").alias("_before")), keys, "asked_s", "_before")
    sides = as_of(sides, targets.select(*keys, F.col("at_s").alias("_after")), keys, "asked_s", "_after", forward=True)
    near = sides.select(*keys, "asked_s", F.explode(F.array("_before", "_after")).alias("at_s")).where(F.abs(F.col("at_s") - F.col("asked_s")) <= radius_s)
    order = F.struct("priority", F.abs(F.col("at_s") - F.col("asked_s")), "at_s")
    best = near.groupBy("stream", "asked_s").agg(F.min_by(F.struct("at_s", "priority"), order).alias("b"))
    return best.select("stream", "asked_s", "b.at_s", "b.priority")


def garbled_until(words: DataFrame, window: int = 10, least_s: float = 60.0, key: str = "doc_id") -> DataFrame:
    """(key, start_ms, resume_ms): runs of windows of ``window`` words with at most 2 distinct ones, or 3 with one word
    eight times, that last ``least_s`` or more; resume is the end of the run's last word."""
    ordered = W.partitionBy(key).orderBy("pos")
    said = F.transform(F.collect_list("word").over(ordered.rowsBetween(0, window - 1)), F.lower)
    rows = words.select(key, "pos", "start_ms", F.last("end_ms").over(ordered.rowsBetween(0, window - 1)).alias("last_ms"), said.alias("ws"))
    distinct = F.size(F.array_distinct("ws"))
    most = F.array_max(F.transform(F.array_distinct("ws"), lambda w: F.size(F.filter("ws", lambda x: x == w))))
    bad = (F.size("ws") == window) & ((distinct <= 2) | ((distinct <= 3) & (most >= 8)))
    marked = rows.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.where("_bad").groupBy(key, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("last_ms").alias("resume_ms"))
    return runs.where(F.col("resume_ms") - F.col("start_ms") >= least_s * 1000).select(key, "start_ms", "resume_ms")


def paragraph_breaks(words: DataFrame, sentences: DataFrame, pause_ms: int = 2000, within: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, paragraph, byte_start, byte_end): a pause of ``pause_ms`` or more breaks at the nearest sentence start within
    ``within`` words (the earlier on ties), never at the first. Sentences and words share byte places.

    Words, or lists of them (``timing.word_lists``), are looked at in a key's row, so only those around a pause are joined."""
    from .sequence import listed

    lists = listed(words, key, ["byte_start", "start_ms", "end_ms"]).where("size(ws) > 1")
    at = F.filter(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.get("ws", i)["start_ms"] - F.get("ws", i - 1)["end_ms"] >= pause_ms)

    def around(i: Column) -> Column:
        first = F.greatest(i - within, F.lit(0))
        return F.transform(F.slice("ws", first + 1, i - first + within + 1), lambda w: F.struct(F.get("ws", i)["pos"].alias("_p"), w["pos"].alias("_w"), w["byte_start"].alias("byte_start")))

    spread = lists.select(key, F.explode(F.flatten(F.transform(at, around))).alias("x")).select(key, "x.*").where(F.abs(F.col("_w") - F.col("_p")) <= within)
    first = sentences.groupBy(key).agg(F.min("ordinal").alias("_first"))
    near = spread.join(sentences.select(key, "ordinal", "byte_start"), [key, "byte_start"]).join(first, key).where(F.col("ordinal") > F.col("_first"))
    chosen = near.groupBy(key, "_p").agg(F.min_by("ordinal", F.struct(F.abs(F.col("_w") - F.col("_p")), "ordinal")).alias("ordinal")).select(key, "ordinal").distinct()
    rows = sentences.join(chosen.withColumn("_b", F.lit(1)), [key, "ordinal"], "left")
    number = F.sum(F.coalesce("_b", F.lit(0))).over(W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("paragraph", number).groupBy(key, "paragraph").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
