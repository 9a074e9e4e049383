"""Segments of a stream matched to its scheduled talks: signals, scores, leftovers, reconciliation.

``words`` (stream, pos, word, start_s, end_s), ``segments`` (stream, segment,
start_s, end_s, kind), ``talks`` (stream, talk, title, speakers array, starts_s).
All of it is equi-joins on (stream, sound or word or bucket of time) and windows;
one step, the second pass, depends on what was taken before it and runs as a
grouped map over the few candidates that are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import phonetic_code
from spanloom.sources.files import small, written

from .intervals import as_of, containment_join
from .sequence import first_rows

# fixed values: words that are no names after "I'm"; title words that don't count; ranks of confidence
NO_NAMES = "So And The It We Not But All Just Very Really Here Going Sure Like One How Also Super Trying Kind From A".split()
TITLE_STOPWORDS = "the a an and or but in on at to for of with by is it as be was are not".split()
CONFIDENCE = {"high": 4, "medium": 3, "low": 2, "unverifiable": 1}
# fixed values: what is said around a start (source, window, pattern)
SAID = [
    ("self-intro", "intro", r"\bmy name(?:'s| is)\s+([A-Z][a-z]+)"), ("self-intro", "intro", r"\bI'm\s+([A-Z][a-z]+)"),
    ("mc-handoff", "before", r"(?i)\bplease welcome\s+([A-Z][a-z]+)"), ("mc-handoff", "before", r"(?i)\bnext up (?:is|we have)\s+([A-Z][a-z]+)"),
]
NEAR_S = 600.0

Coder = Callable[[Column], Column]


def sounds(words: Column) -> Column:
    return F.pandas_udf(phonetic_code, "string")(words)


def _coded(rows: DataFrame, token: str, code: Coder) -> DataFrame:
    """Distinct (stream, token) of three letters or more with their ``code``; each token is coded once."""
    tokens = rows.select("stream", token).distinct().where(F.length(token) >= 3)
    return tokens.join(tokens.select(token).distinct().withColumn("code", code(F.col(token))), token).where(F.length("code") > 0)


def speaker_parts(talks: DataFrame) -> DataFrame:
    """(stream, talk, part): the parts of the speakers' names of three letters or more."""
    parts = talks.select("stream", "talk", F.explode("speakers").alias("s")).select("stream", "talk", F.explode(F.split(F.trim("s"), r"\s+")).alias("part"))
    return parts.where(F.length("part") >= 3).distinct()


def window_texts(heard: DataFrame, keys: list[str], size: int = 500) -> DataFrame:
    """(``keys``, text): words (pos, word) joined in order. They are numbered by a sort, which spills, and joined by ``size``
    before a text's parts meet: a crowded window has hundreds of thousands, too many for one list of structs."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("pos", "word"))
    parts = heard.where("word is not null").withColumn("_part", F.floor((place - 1) / size)).groupBy(*keys, "_part")
    parts = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("_text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_text"))), lambda p: p["_text"]), " ")
    return parts.groupBy(*keys).agg(text.alias("text"))


def segment_signals(words: DataFrame, segments: DataFrame, talks: DataFrame, code: Coder = sounds, intro_s: float = 120.0, before_s: float = 60.0) -> DataFrame:
    """(stream, segment, source, name): names said in introductions (self-intro) and before them (mc-handoff), names of
    the schedule that sound like a word of either (name-scan), and the words of the introduction (topic).

    The introduction is the segment's first ``intro_s``, the hand-off the
    ``before_s`` before it; a text here is bounded by these. Two names sound alike
    if the first three places of their codes agree, or all but different first vowels.
    """
    keys = ["stream", "segment"]
    intro = segments.select(*keys, F.lit("intro").alias("window"), F.col("start_s").alias("_from"), F.least(F.col("start_s") + intro_s, "end_s").alias("_to"))
    before = segments.select(*keys, F.lit("before").alias("window"), F.greatest(F.col("start_s") - before_s, F.lit(0.0)).alias("_from"), F.col("start_s").alias("_to"))
    windows = small(written(intro.union(before), "windows"))
    heard = containment_join(words.select("stream", "pos", "word", "start_s", "end_s"), windows, ["stream"], "start_s", "end_s", "_from", "_to", intro_s)
    # all below read the words of the windows, a small part of the stream's, several times: the words themselves are read once
    heard = written(heard.select(*keys, "window", "pos", "word"), "heard")
    texts = window_texts(heard, [*keys, "window"])
    named = lambda source, names: F.transform(names, lambda n: F.struct(F.lit(source).alias("source"), n.alias("name")))
    found = [F.when(F.col("window") == window, named(source, F.regexp_extract_all("text", F.lit(p), 1))) for source, window, p in SAID]
    found.append(F.when((F.col("window") == "before") & F.col("text").rlike(r"(?i)\bsetting up next\b"), F.array(F.struct(F.lit("mc-handoff").alias("source"), F.lit("").alias("name")))))
    bag = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) >= 4)
    found.append(F.when(F.col("window") == "intro", named("topic", F.array_distinct(bag))))
    said = texts.select(*keys, F.explode(F.flatten(F.array(*[F.coalesce(f, F.array()) for f in found]))).alias("f")).select(*keys, "f.source", "f.name").distinct()
    said = said.where((F.col("source") != "self-intro") | ~F.col("name").isin(*NO_NAMES))

    token = F.regexp_replace(F.lower("word"), "[^a-z'-]", "")
    near = written(heard.select(*keys, token.alias("token")).distinct(), "near")
    known = _coded(speaker_parts(talks), "part", code).withColumnRenamed("code", "_ca")
    spoken = _coded(near, "token", code)
    start = known.withColumn("_k", F.substring("_ca", 1, 3)).join(spoken.withColumn("_k", F.substring("code", 1, 3)), ["stream", "_k"])
    vowel, tail = "^[AEIOU]", lambda c: F.expr(f"substring({c}, 2)")
    after = known.where(F.col("_ca").rlike(vowel)).withColumn("_k", tail("_ca")).join(spoken.where(F.col("code").rlike(vowel) & (F.length("code") >= 2)).withColumn("_k", tail("code")), ["stream", "_k"])
    alike = start.select("stream", "part", "token").union(after.select("stream", "part", "token")).distinct()
    scan = near.join(alike, ["stream", "token"]).select(*keys, F.lit("name-scan").alias("source"), F.col("part").alias("name")).distinct()
    taken = said.where("source <> 'topic'").select(*keys, F.lower("name").alias("_low")).distinct()
    scan = scan.withColumn("_low", F.lower("name")).join(taken, [*keys, "_low"], "left_anti").drop("_low")
    return said.unionByName(scan)


def title_keywords(title: Column) -> Column:
    """Lower-case words of four letters or more, with repeats."""
    words = F.split(F.lower(F.regexp_replace(title, r"[^\w\s]", " ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*TITLE_STOPWORDS))


def _evidence(signals: DataFrame, talks: DataFrame, code: Coder) -> DataFrame:
    """(stream, segment, talk, sources, topics): which sources name one of a talk's speakers, and how many words of its
    title were said."""
    keys = ["stream", "segment", "talk"]
    spoken = signals.where("source <> 'topic' and name <> ''")
    a = _coded(spoken, "name", code).select("stream", "name", F.substring("code", 1, 3).alias("_k"))
    parts = speaker_parts(talks)
    b = _coded(parts, "part", code).select("stream", "part", F.substring("code", 1, 3).alias("_k"))
    alike = a.join(b, ["stream", "_k"]).select("stream", "name", "part")
    named = spoken.join(alike, ["stream", "name"]).join(parts, ["stream", "part"]).groupBy(*keys).agg(F.collect_set("source").alias("sources"))
    titles = talks.select("stream", "talk", F.explode(title_keywords(F.col("title"))).alias("name"))
    topics = signals.where("source = 'topic'").join(titles, ["stream", "name"]).groupBy(*keys).agg(F.count("*").alias("topics"))
    return named.join(topics, keys, "full").select(*keys, F.coalesce("sources", F.array()).alias("sources"), F.coalesce("topics", F.lit(0)).alias("topics"))


def _judged(pairs: DataFrame, segments: DataFrame, talks: DataFrame) -> DataFrame:
    """Pairs (stream, segment, talk, sources, topics) with places, time offset, source, score and confidence.

    A talk is expected as long after the first segment as it is scheduled after
    the first talk of the stream. A panel's best source is the self-introduction,
    then the scan, then the hand-off; else the hand-off comes before the scan.
    """
    anchors = talks.groupBy("stream").agg(F.min("starts_s").alias("_t0")).join(segments.groupBy("stream").agg(F.min("start_s").alias("_s0")), "stream")
    rows = pairs.join(segments.select("stream", "segment", "start_s", "end_s", (F.col("kind") == "panel").alias("panel")), ["stream", "segment"])
    rows = rows.join(talks.select("stream", "talk", "starts_s"), ["stream", "talk"]).join(anchors, "stream")
    rows = rows.withColumn("off_s", F.abs(F.col("start_s") - (F.col("starts_s") - F.col("_t0") + F.col("_s0")))).drop("_t0", "_s0")
    has = lambda s: F.array_contains("sources", s)
    source = F.when(has("self-intro"), "self-intro").when(F.col("panel") & has("name-scan"), "name-scan").when(has("mc-handoff"), "mc-handoff").when(has("name-scan"), "name-scan")
    rows = rows.withColumns({"source": source, "near": F.coalesce(F.col("off_s") <= NEAR_S, F.lit(False))})
    said = F.when(F.col("source") == "self-intro", 3.0).when(F.col("source") == "name-scan", 2.5).when(F.col("source") == "mc-handoff", 2.0).otherwise(0.0)
    score = said + F.least(F.col("topics"), F.lit(2)) + F.when(F.col("near"), F.greatest(1.5 - F.col("off_s") / NEAR_S, F.lit(0.0))).otherwise(0.0)
    name, many, some = F.col("source").isNotNull(), F.col("topics") >= 2, F.col("topics") >= 1
    high = (name & many) | (F.col("near") & name & some)
    medium = (name & F.col("source").isin("self-intro", "name-scan")) | many | (F.col("near") & (name | some))
    return rows.withColumns({"score": score, "confidence": F.when(high, "high").when(medium, "medium").otherwise("low")})


OUT = ["stream", "segment", "talk", "start_s", "end_s", "confidence", "score", "panel"]


def match_segments(signals: DataFrame, segments: DataFrame, talks: DataFrame, code: Coder = sounds) -> DataFrame:
    """(stream, segment, talk, start_s, end_s, confidence, score, panel): for each segment the talk of the best score
    (ties to the earlier talk, then its key) among those whose speaker is named or of whose title two words were said;
    panels keep all such talks, and those near in time with one word."""
    rows = _judged(_evidence(signals, talks, code), segments, talks)
    fits = F.col("source").isNotNull() | (F.col("topics") >= 2) | (F.col("panel") & F.col("near") & (F.col("topics") >= 1))
    place = F.row_number().over(W.partitionBy("stream", "segment", "panel").orderBy(F.desc("score"), F.asc_nulls_last("starts_s"), "talk"))
    return rows.where(fits).withColumn("_place", place).where("panel or _place = 1").select(*OUT)


def match_leftovers(signals: DataFrame, segments: DataFrame, talks: DataFrame, matches: DataFrame, code: Coder = sounds) -> DataFrame:
    """Second pass over segments that start 5 s or more from any match, and talks without one; columns as matches.

    In order of time, a segment takes the best talk left whose speaker is named,
    of whose title one word was said, or that is near in time; not if several are
    near in time only. Then the n-th segment left meets the n-th talk left (talks without a time last), if
    they are at most 20 minutes apart (confidence low, score 0).
    """
    taken = matches.select("stream", F.col("start_s").alias("_m")).distinct()
    taken = taken.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_m") - 5) / 5), F.floor((F.col("_m") + 5) / 5))))
    free = segments.withColumn("_b", F.floor(F.col("start_s") / 5)).alias("s")
    near = (F.col("s.stream") == F.col("t.stream")) & (F.col("s._b") == F.col("t._b")) & (F.abs(F.col("s.start_s") - F.col("t._m")) < 5)
    free = free.join(taken.alias("t"), near, "left_anti").drop("_b")
    open_talks = talks.join(matches.select("stream", "talk").distinct(), ["stream", "talk"], "left_anti")

    keys = ["stream", "segment", "talk"]
    said = _evidence(signals.join(free.select("stream", "segment"), ["stream", "segment"], "left_semi"), open_talks, code)
    anchors = talks.groupBy("stream").agg(F.min("starts_s").alias("_t0")).join(segments.groupBy("stream").agg(F.min("start_s").alias("_s0")), "stream")
    due = open_talks.where("starts_s is not null").join(anchors, "stream").select("stream", "talk", "starts_s", (F.col("starts_s") - F.col("_t0") + F.col("_s0")).alias("due_s"))
    a = free.select("stream", "segment", "start_s", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("start_s") / NEAR_S) + k)).alias("_b"))
    timely = a.join(due.withColumn("_b", F.floor(F.col("due_s") / NEAR_S)), ["stream", "_b"]).where(F.abs(F.col("start_s") - F.col("due_s")) <= NEAR_S).select(*keys)
    pairs = timely.join(said, keys, "full").select(*keys, F.coalesce("sources", F.array()).alias("sources"), F.coalesce("topics", F.lit(0)).alias("topics"))
    # offsets count from all segments and talks, so places of the matched ones are looked up too
    rows = _judged(pairs, segments, talks).select(*OUT, "starts_s", (F.col("source").isNull() & (F.col("topics") < 1)).alias("bare"))

    def choose(pdf):
        used, kept = set(), []
        pdf = pdf.sort_values(["start_s", "segment", "score", "starts_s", "talk"], ascending=[True, True, False, True, True])
        for _, options in pdf.groupby(["start_s", "segment"], sort=False):
            options = options[~options["talk"].isin(used)]
            if len(options) and not (len(options) > 1 and options["bare"].all()):
                kept.append(options.index[0])
                used.add(options["talk"].iloc[0])
        return pdf.loc[kept, OUT]

    kinds = dict(rows.dtypes)
    loose = written(rows.groupBy("stream").applyInPandas(choose, ", ".join(f"{c} {kinds[c]}" for c in OUT)), "loose")
    left = free.join(loose.select("stream", "segment"), ["stream", "segment"], "left_anti").withColumn("_n", F.row_number().over(W.partitionBy("stream").orderBy("start_s", "segment")))
    rest = open_talks.join(loose.select("stream", "talk"), ["stream", "talk"], "left_anti").select("stream", "talk", F.row_number().over(W.partitionBy("stream").orderBy(F.asc_nulls_last("starts_s"), "talk")).alias("_n"))
    paired = left.join(rest, ["stream", "_n"]).join(due.select("stream", "talk", "due_s"), ["stream", "talk"]).where(F.abs(F.col("start_s") - F.col("due_s")) <= 2 * NEAR_S)
    paired = paired.select("stream", "segment", "talk", "start_s", "end_s", F.lit("low").alias("confidence"), F.lit(0.0).alias("score"), (F.col("kind") == "panel").alias("panel"))
    return loose.unionByName(paired)


def reconcile(matches: DataFrame, segments: DataFrame, talks: DataFrame, zones: DataFrame, lengths: DataFrame, break_s: float = 60.0, around_s: float = 5.0) -> DataFrame:
    """(stream, status, talk, segment, start_s, end_s, confidence): one row a talk, and one for each segment without one.

    A talk keeps its match of highest confidence, then earliest start. It ends at
    the next talk's start if that is at most ``break_s`` later, else with the
    segment that began last by its start; the stream's last talk no later than
    the stream (``lengths``: stream, duration_s). Talks without a match are
    unverifiable (start 0) if scheduled inside a zone, else open; a segment is
    open if no match starts within ``around_s`` of it.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence"))
    best = first_rows(matches.select("stream", "talk", "start_s", "confidence"), ["stream", "talk"], [F.desc(rank), "start_s"])
    following = F.lead("start_s").over(W.partitionBy("stream").orderBy("start_s", "talk"))
    points = best.withColumns({"_next": following, "_when": F.col("start_s") + 1})
    rows = as_of(points, segments.select("stream", F.col("start_s").alias("_s"), F.col("end_s").alias("_e")), ["stream"], "_when", "_s").join(lengths.select("stream", "duration_s"), "stream", "left")
    end = F.when(F.col("_next").isNull(), F.least("duration_s", "_e")).when(F.col("_next") - F.col("start_s") <= break_s, F.col("_next")).otherwise(F.coalesce("_e", "duration_s"))
    none = lambda kind: F.lit(None).cast(kind)
    number = segments.schema["segment"].dataType
    out = rows.select("stream", F.lit("matched").alias("status"), "talk", none(number).alias("segment"), "start_s", end.alias("end_s"), "confidence")
    rest = talks.join(best.select("stream", "talk"), ["stream", "talk"], "left_anti").select("stream", "talk", F.col("starts_s").alias("_a"))
    zone = zones.select("stream", F.col("start_s").alias("_zs"), F.col("end_s").alias("_ze"))
    inside = containment_join(rest.where("_a is not null"), zone, ["stream"], "_a", "_a", "_zs", "_ze", 300.0).select("stream", "talk", F.lit(True).alias("_in")).distinct()
    rest = rest.join(inside, ["stream", "talk"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    status = F.when(F.col("_in"), "unverifiable").otherwise("open talk")
    out = out.union(rest.select("stream", status, "talk", none(number), F.when(F.col("_in"), 0.0), none("double"), F.when(F.col("_in"), "unverifiable")))
    reach = segments.select("stream", "segment", (F.col("start_s") - around_s).alias("_from"), (F.col("end_s") + around_s).alias("_to"))
    hit = containment_join(best.select("stream", "start_s"), reach, ["stream"], "start_s", "start_s", "_from", "_to", 300.0).select("stream", "segment").distinct()
    bare = segments.join(hit, ["stream", "segment"], "left_anti")
    return out.union(bare.select("stream", F.lit("open segment"), none(dict(talks.dtypes)["talk"]), "segment", "start_s", "end_s", none("string")))


def detect_boundaries(words: DataFrame, diarization: DataFrame, talks: DataFrame, lengths: DataFrame, code: Coder = sounds) -> DataFrame:
    """The whole chain: garbage zones, segments of speech, matches in two passes, reconciled with the schedule. Each
    stage is written to the shared folder, as the next ones read it several times."""
    from .sequence import may_loop, speech_blocks
    from .sequence import talk_segments as cut
    from .spans import zones_of

    zones = zones_of(words, diarization, may_loop(words, key="stream"))
    segments = written(cut(speech_blocks(diarization)), "segments")
    signals = written(segment_signals(words, segments, talks, code), "signals")
    first = written(match_segments(signals, segments, talks, code), "matches")
    second = match_leftovers(signals, segments, talks, first, code)
    return reconcile(first.unionByName(second), segments, talks, zones, lengths)
