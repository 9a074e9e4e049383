"""From gaps to the starts of talks: pairs of gaps and talks scored, a gap chosen for each talk, the start refined.

Gaps and talks meet in buckets of time, never all with all. Names are heard by
sound through distinct words only (``phonetic_name_join``); a pair then compares
two short arrays in place. The choice of gaps is one fold over a stream's talks,
which looks up its gaps by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.files import written

from .boundaries import phonetic_name_join
from .sequence import listed

# fixed values: title words that say nothing
COMMON_TITLE_WORDS = ("about", "their", "these", "those", "where", "which", "would", "could", "should")
# fixed values: what is said where a talk starts, with weights
STARTS = [
    ("greeting", r"^(hello|hi)\s+(everyone|there|folks)", 8), ("self-intro", r"my\s+name\s+is", 10), ("talk-about", r"i'?m\s+(going\s+to|gonna)\s+(talk|present|show|discuss)", 8),
    ("so-today", r"so\s+(today|this\s+talk|i\s+want\s+to)", 5), ("thanks-for-intro", r"thank\s+you.*\s+(so|for)\s+(having|inviting|the\s+intro)", 6),
]


def clean(word: Column) -> Column:
    """A heard word as names are compared with it."""
    return F.regexp_replace(F.lower(word), "[^a-z'-]", "")


def name_parts(talks: DataFrame) -> DataFrame:
    """(stream, talk, part): the distinct parts of the speakers' names of three letters or more, in lower case."""
    return talks.select("stream", "talk", F.explode("speakers").alias("s")).select("stream", "talk", F.explode(F.split(F.lower(F.trim("s")), r"\s+")).alias("part")).where(F.length("part") >= 3).distinct()


def sounds(said: DataFrame, parts: DataFrame, code: Callable | None = None) -> DataFrame:
    """(word, part): words of ``said`` (word, cleaned) that sound like a part of a name, written once."""
    names = parts.select(F.col("part").alias("name_id"), F.col("part").alias("name")).distinct()
    return written(phonetic_name_join(names, said.distinct(), code), "sounds").select("word", F.col("name_id").alias("part"))


def with_heard_parts(rows: DataFrame, parts: DataFrame, keys: list[str], said: str, code: Callable | None = None) -> DataFrame:
    """``rows`` with ``heard``, the parts of names (part) that a word of ``said`` (cleaned, distinct) sounds like, in place
    of ``said``. ``keys`` find rows; rows of equal keys keep their own words.

    A row has the few parts heard in it; a talk never has the words of the corpus that sound like its speakers.
    """
    each = rows.select(*keys, F.explode(said).alias("word"))
    found = each.join(sounds(each.select("word"), parts, code), "word").groupBy(*keys).agg(F.collect_set(F.struct("word", "part")).alias("_pairs"))
    own = F.filter("_pairs", lambda p: F.array_contains(said, p["word"]))
    return rows.join(found, keys, "left").withColumn("heard", F.array_distinct(own["part"])).drop("_pairs", said)


def planned_starts(talks: DataFrame) -> DataFrame:
    """``talks`` (stream, place, talk, duration_s, first_s) with ``due_s``: the first start plus the lengths before, each
    with 3 minutes (1 after talks of 10 minutes or less)."""
    step = F.col("duration_s") + F.when(F.col("duration_s") <= 600, 60).otherwise(180)
    ordered = W.partitionBy("stream").orderBy("place", "talk")
    before = F.coalesce(F.sum(step).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return talks.withColumn("due_s", F.first("first_s").over(ordered) + before)


def score_gap_talk_pairs(gaps: DataFrame, talks: DataFrame, within_s: float = 7200.0, code: Callable | None = None) -> DataFrame:
    """(stream, talk, at_s, bonus), where it isn't 0: 10 if a speaker's name is heard around a gap, and 3 for each title
    word of five letters or more in the text there, from two on.

    ``gaps``: (stream, at_s, before, after), arrays of words; ``talks``: (stream, talk, title, speakers, due_s). Pairs are
    gaps within ``within_s`` of a talk's planned start; both are dealt to buckets of that length. A gap's text is shuffled
    once, to its bucket; a bucket's talks know the numbers of the gaps in which their names are heard.
    """
    parts, at = name_parts(talks), ["stream", "_bucket"]
    # names and titles read the gaps' words several times; numbers stay as they are, once written
    g = gaps.select("stream", "at_s", F.concat("before", "after").alias("_words"), F.monotonically_increasing_id().alias("_gap"))
    g = written(g, "gap-words").withColumn("_bucket", F.floor(F.col("at_s") / within_s))
    each = g.select(*at, "_gap", F.explode(F.array_distinct(F.transform("_words", clean))).alias("word"))
    heard = each.join(sounds(each.select("word"), parts, code), "word").groupBy(*at).agg(F.collect_set(F.struct("_gap", "part")).alias("_heard"))
    g = g.select(*at, "at_s", "_gap", F.lower(F.array_join("_words", " ")).alias("_text"))
    title = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: (F.length(w) > 4) & ~w.isin(*COMMON_TITLE_WORDS))
    own = parts.groupBy("stream", "talk").agg(F.collect_set("part").alias("_parts"))
    t = talks.join(own, ["stream", "talk"], "left").select("stream", "talk", "due_s", "_parts", title.alias("_title"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("due_s") / within_s) + k)).alias("_bucket"))
    mine = F.filter("_heard", lambda h: F.array_contains("_parts", h["part"]))["_gap"]
    t = t.join(heard, at, "left").withColumn("_named", mine).drop("_heard", "_parts")
    pairs = t.join(g, at).where(F.abs(F.col("at_s") - F.col("due_s")) <= within_s)
    named = F.when(F.coalesce(F.array_contains("_named", F.col("_gap")), F.lit(False)), 10).otherwise(0)
    pairs = pairs.withColumn("_n", F.size(F.filter(F.coalesce("_title", F.expr("cast(array() as array<string>)")), lambda w: F.contains(F.col("_text"), w))))
    scored = pairs.select("stream", "talk", "at_s", (named + F.when(F.col("_n") >= 2, 3 * F.col("_n")).otherwise(0)).cast("long").alias("bonus"))
    return scored.where("bonus > 0")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def assign_transitions(talks: DataFrame, gaps: DataFrame, bonus: DataFrame | None = None, size_s: float = 600.0) -> DataFrame:
    """(stream, talk, at_s, score): for each talk in order the best gap around its expected start.

    ``talks``: (stream, place, talk, duration_s, first_s). A talk is expected
    after the one before plus its length and 3 minutes (1 after talks of 10
    minutes or less), moved by the drift so far; the window is 0.6 of that
    length, 10 minutes at least; nearness adds up to 5, and ``bonus`` (stream,
    talk, at_s, bonus) its own part. Half of each surprise becomes drift; the
    earlier gap wins ties. Without a gap the expected time stands, at score 0.

    A stream's talks are folded in order; its gaps lie in an array of buckets of
    ``size_s``, of which a talk reads the few around its expected start.
    """
    kinds = dict(talks.dtypes)
    one = gaps.select("stream", F.col("at_s").cast("double").alias("at_s"), F.col("score").cast("double").alias("score"), F.floor(F.col("at_s") / size_s).alias("_b"))
    cells = one.groupBy("stream", "_b").agg(F.sort_array(F.collect_list(F.struct("at_s", "score"))).alias("g"))
    none = F.expr("cast(array() as array<struct<at_s: double, score: double>>)")
    g = cells.groupBy("stream").agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"), F.map_from_entries(F.collect_list(F.struct("_b", "g"))).alias("_m"))
    g = g.select("stream", "_first", F.transform(F.sequence("_first", "_last"), lambda b: F.coalesce(F.try_element_at("_m", b), none)).alias("_cells"))
    extra = F.expr("cast(array() as array<struct<at_s: double, bonus: double>>)")
    rows = planned_starts(talks)
    if bonus is not None:
        more = bonus.groupBy("stream", "talk", F.col("at_s").cast("double").alias("at_s")).agg(F.sum(F.col("bonus").cast("double")).alias("bonus"))
        rows = rows.join(more.groupBy("stream", "talk").agg(F.collect_list(F.struct("at_s", "bonus")).alias("_e")), ["stream", "talk"], "left")
    else:
        rows = rows.withColumn("_e", extra)
    before = F.lag(F.col("duration_s").cast("double")).over(W.partitionBy("stream").orderBy("place", "talk"))
    each = F.struct("place", "talk", F.col("due_s").cast("double").alias("due"), F.col("_d").alias("d"), F.coalesce("_e", extra).alias("e"))
    t = rows.withColumn("_d", before).groupBy("stream").agg(F.sort_array(F.collect_list(each)).alias("_talks"))
    both = t.join(g, "stream", "left").withColumns({"_cells": F.coalesce("_cells", F.expr("cast(array() as array<array<struct<at_s: double, score: double>>>)")), "_first": F.coalesce("_first", F.lit(0))})

    def choose(x: Column, expected: Column, reach: Column) -> Column:
        """The best (minus value, at) in the window; null without one."""
        lo = F.greatest(F.floor((expected - reach) / size_s) - F.col("_first"), F.lit(0))
        n = F.greatest(F.floor((expected + reach) / size_s) - F.col("_first") - lo + 1, F.lit(0))
        near = F.filter(F.flatten(F.slice("_cells", (lo + 1).cast("int"), n.cast("int"))), lambda c: F.abs(c["at_s"] - expected) <= reach)
        added = lambda c: F.aggregate(x["e"], F.lit(0.0), lambda a, e: a + F.when(e["at_s"] == c["at_s"], e["bonus"]).otherwise(0.0))
        valued = F.transform(near, lambda c: F.struct((-(c["score"] + 5 * (1 - F.abs(c["at_s"] - expected) / reach) + added(c))).alias("minus"), c["at_s"].alias("at")))
        return F.array_min(F.filter(valued, lambda v: v["minus"] < 1))

    empty = F.struct(F.expr(f"cast(array() as array<struct<talk: {kinds['talk']}, at_s: double, score: double>>)").alias("out"), F.lit(0.0).alias("drift"), F.lit(0.0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        def put(best: Column, expected: Column) -> Column:
            at = F.coalesce(best["at"], expected)
            moved = F.when(best["at"].isNull(), 0.0).otherwise(0.5 * (at - acc["last"] - x["d"] - 180))
            return F.struct(F.concat(acc["out"], F.array(F.struct(x["talk"].alias("talk"), at.alias("at_s"), F.coalesce(-best["minus"], F.lit(0.0)).alias("score")))).alias("out"), (acc["drift"] + moved).alias("drift"), at.alias("last"))

        first = F.struct(F.array(F.struct(x["talk"].alias("talk"), x["due"].alias("at_s"), F.lit(0.0).alias("score"))).alias("out"), F.lit(0.0).alias("drift"), x["due"].alias("last"))
        expected, reach = x["due"] + acc["drift"], F.greatest(0.6 * x["d"], F.lit(600.0))
        return F.when(x["d"].isNull(), first).otherwise(_let(choose(x, expected, reach), lambda best: put(best, expected)))

    return both.select("stream", F.explode(F.aggregate("_talks", empty, step, lambda acc: acc["out"])).alias("r")).select("stream", "r.talk", "r.at_s", "r.score")


def refine_start(words: DataFrame, starts: DataFrame, within_s: float = 900.0, least: int = 8, pause_s: float = 5.0, code: Callable | None = None) -> DataFrame:
    """(stream, talk, start_s, score, signal): the best place in the ``within_s`` after a talk's gap at which it seems to start.

    ``words``: (stream, pos, word, start_s, end_s), or lists of them (stream, ws); ``starts``: (stream, talk,
    at_s, speakers). A word after a pause of ``pause_s`` scores the start phrases
    of its 15 words and 12 if a speaker is heard in its 20; every fifth word
    scores the best phrase of its 10 words plus 8 if a speaker is heard there.
    The first of the highest wins; below ``least`` the gap's time stands, without
    a score. Phrases are looked for once a word, not once a talk; marks and talks
    meet in buckets of time.
    """
    lists = listed(words, "stream", ["word", "start_s", "end_s"])
    gap = lambda i: F.get("ws", i)["start_s"] - F.get("ws", i - 1)["end_s"]
    places = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (gap(i) >= pause_s) | (i % 5 == 0))
    each = F.transform(places, lambda i: F.struct(F.get("ws", i)["start_s"].alias("start_s"), i.alias("i"), gap(i).alias("_gap"), F.slice("ws", i + 1, F.lit(20))["word"].alias("_ws")))
    rows = lists.where("size(ws) > 0").select("stream", F.explode(each).alias("p")).select("stream", "p.*")
    text = lambda n: F.array_join(F.slice("_ws", 1, n), " ")
    found = lambda n: F.filter(F.array(*[F.when(text(n).rlike(f"(?i){p}"), F.struct(F.lit(w).alias("w"), F.lit(-k).alias("k"), F.lit(label).alias("label"))) for k, (label, p, w) in enumerate(STARTS)]), lambda x: x.isNotNull())
    said = lambda n: F.array_distinct(F.transform(F.slice("_ws", 1, n), clean))
    labels = lambda f: F.array_join(F.transform(f, lambda x: x["label"]), "+")
    pause = F.struct(F.lit(0).alias("kind"), F.aggregate("_f15", F.lit(0), lambda a, x: a + x["w"]).alias("w"), labels(F.col("_f15")).alias("label"), said(20).alias("_said"))
    fifth = F.struct(F.lit(1).alias("kind"), F.col("_f10.w").alias("w"), F.col("_f10.label").alias("label"), said(10).alias("_said"))
    both = F.array_compact(F.array(F.when(F.col("_gap") >= pause_s, pause), F.when(F.col("_f10").isNotNull(), fifth)))
    rows = rows.withColumns({"_f15": F.when(F.col("_gap") >= pause_s, found(15)), "_f10": F.when(F.col("i") % 5 == 0, F.array_max(found(10)))})
    marks = rows.select("stream", "start_s", "i", F.floor(F.col("start_s") / within_s).alias("_bucket"), F.explode(both).alias("m")).select("stream", "start_s", "i", "_bucket", "m.*")
    parts = name_parts(starts)
    marks = with_heard_parts(written(marks, "marks"), parts, ["stream", "i", "kind"], "_said", code)
    own = parts.groupBy("stream", "talk").agg(F.collect_set("part").alias("_parts"))
    asked = starts.join(own, ["stream", "talk"], "left").select("stream", "talk", "at_s", "_parts", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(F.col("at_s") / within_s) + k)).alias("_bucket"))
    near = asked.join(marks, ["stream", "_bucket"]).where(F.col("start_s").between(F.col("at_s"), F.col("at_s") + within_s))
    named = F.coalesce(F.arrays_overlap("_parts", "heard"), F.lit(False))
    near = near.withColumn("_named", named).where(F.col("_named") | (F.col("kind") == 0))
    score = F.col("w") + F.when(F.col("kind") == 1, 8).otherwise(F.when(F.col("_named"), 12).otherwise(0))
    signal = F.when(F.col("kind") == 1, F.concat("label", F.lit("+speaker"))).otherwise(F.concat_ws("+", F.when(F.col("_named"), "speaker-after-gap"), F.nullif("label", F.lit(""))))
    scored = near.select("stream", "talk", "at_s", "start_s", "i", "kind", score.alias("score"), signal.alias("signal")).where(F.col("score") > 0)
    best = scored.groupBy("stream", "talk", "at_s").agg(F.min_by(F.struct("start_s", "score", "signal"), F.struct(-F.col("score"), "i", "kind")).alias("b"))
    fine = (F.col("b.score") >= least) & (F.col("b.start_s") > F.col("at_s"))
    out = starts.select("stream", "talk", "at_s").join(best, ["stream", "talk", "at_s"], "left")
    return out.select("stream", "talk", F.when(fine, F.col("b.start_s")).otherwise(F.col("at_s")).alias("start_s"), F.when(fine, F.col("b.score")).cast("long").alias("score"), F.when(fine, F.col("b.signal")).otherwise("").alias("signal"))
