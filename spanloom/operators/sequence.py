"""Window and ordered operators on words, speaker segments, gaps and zones.

Everything is keyed (a document or a stream) and ordered inside its key; rows
of one key are sorted together, so a key must fit in a task's sort, which spills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.files import small, written

from .intervals import containment_join, islands, of_keys

BEFORE = (W.unboundedPreceding, 0)


def silence_gaps(words: DataFrame, least_ms: int = 3000, key: str = "doc_id") -> DataFrame:
    """(key, pos, gap_start_ms, gap_end_ms, gap_ms) where a word starts ``least_ms`` or more after the last one ended."""
    last = F.lag("end_ms").over(W.partitionBy(key).orderBy("pos"))
    rows = words.select(key, "pos", last.alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
    return rows.withColumn("gap_ms", F.col("gap_end_ms") - F.col("gap_start_ms")).where(F.col("gap_ms") >= least_ms)


def listed(words: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, ws): a key's words in order as one list of structs of ``pos`` and ``columns``. Words that come as such lists
    (``timing.word_lists``) stay as they are, without a shuffle."""
    if "ws" in words.columns:
        return words
    return words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("ws"))


def with_context(words: DataFrame, start: str, end: str, least: float, before: int, after: int, key: str, columns: list[str], each: Callable[[Column], Column] = lambda w: w, fields: list[str] | None = None) -> DataFrame:
    """(key, ``columns``, gap, past, ahead) at gaps of ``least`` or more: the words before and after as arrays of structs.

    A key's words are listed once, in order, and the list is cut at its gaps alone; the list itself isn't repeated. ``each``
    makes the struct of a listed word: of all words only the times are made, and for those in a context ``fields``, or all.
    """
    lists = listed(words, key, [c for c in words.columns if c not in (key, "pos")])
    at = F.filter(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: each(F.get("ws", i))[start] - each(F.get("ws", i - 1))[end] >= least)

    def cut(i: Column) -> Column:
        own, last, first = each(F.get("ws", i)), each(F.get("ws", i - 1)), F.greatest(i - before, F.lit(0))
        made = lambda part: F.transform(part, lambda w: each(w) if fields is None else F.struct(*[each(w)[f].alias(f) for f in fields]))
        return F.struct(*[own[c].alias(c) for c in columns], (own[start] - last[end]).alias("gap"), made(F.slice("ws", first + 1, i - first)).alias("past"), made(F.slice("ws", i + 1, F.lit(after))).alias("ahead"))

    return lists.where("size(ws) > 1").select(key, F.explode(F.transform(at, cut)).alias("g")).select(key, "g.*")


def gap_context(words: DataFrame, least_ms: int = 3000, before: int = 20, after: int = 30, key: str = "doc_id") -> DataFrame:
    """Gaps with the words before and after them as text."""
    rows = with_context(words if "ws" in words.columns else words.select(key, "pos", "word", "start_ms", "end_ms"), "start_ms", "end_ms", least_ms, before, after, key, ["pos"])
    return rows.select(key, "pos", F.col("gap").alias("gap_ms"), F.array_join("past.word", " ").alias("before"), F.array_join("ahead.word", " ").alias("after"))


def top_gaps(gaps: DataFrame, n: int = 30, key: str = "doc_id") -> DataFrame:
    """The n longest gaps of each key; ties to the earlier one."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("gap_ms"), "pos"))
    return gaps.withColumn("place", place).where(F.col("place") <= n)


def word_boundaries(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, from_ms, to_ms): a word's stretch reaches half-way to its neighbours."""
    ordered = W.partitionBy(key).orderBy("pos")
    left = (F.lag("end_ms").over(ordered) + F.col("start_ms")) / 2
    right = (F.lead("start_ms").over(ordered) + F.col("end_ms")) / 2
    return words.select(key, "pos", F.coalesce(left, F.col("start_ms").cast("double")).alias("from_ms"), F.coalesce(right, F.col("end_ms").cast("double")).alias("to_ms"))


SPEECH = ["start_s", "event_id"]


def speaker_changes(diarization: DataFrame, order: list[str] = SPEECH) -> DataFrame:
    """(stream, at_s, from_speaker, to_speaker) where consecutive segments differ in speaker."""
    last = F.lag("speaker").over(W.partitionBy("stream").orderBy(*order))
    rows = diarization.select("stream", F.col("start_s").alias("at_s"), last.alias("from_speaker"), F.col("speaker").alias("to_speaker"))
    return rows.where(F.col("from_speaker") != F.col("to_speaker"))


def snap_targets(words: DataFrame, diarization: DataFrame, least_s: float = 2.0) -> DataFrame:
    """Mid-points of word gaps over ``least_s`` (priority 1) and speaker changes (priority 2). Words: (stream, pos, start_s, end_s)."""
    last = F.lag("end_s").over(W.partitionBy("stream").orderBy("pos"))
    gaps = words.select("stream", last.alias("a"), F.col("start_s").alias("b")).where(F.col("b") - F.col("a") > least_s)
    gaps = gaps.select("stream", ((F.col("a") + F.col("b")) / 2).alias("at_s"), F.lit(1).alias("priority"))
    return gaps.union(speaker_changes(diarization).select("stream", "at_s", F.lit(2).alias("priority")))


def speech_blocks(diarization: DataFrame, gap_s: float = 5.0, order: list[str] = SPEECH) -> DataFrame:
    """(stream, block, speaker, start_s, end_s): consecutive segments of one speaker less than ``gap_s`` apart.

    A block's end is the largest end inside its run of one speaker.
    """
    ordered = W.partitionBy("stream").orderBy(*order)
    rows = diarization.withColumn("_turn", F.when(F.lag("speaker").over(ordered) == F.col("speaker"), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_turn").over(ordered.rowsBetween(*BEFORE)))
    rows = islands(rows, ["stream", "_run"], "start_s", "end_s", within=gap_s, order=order[1:], strict=True)
    blocks = rows.groupBy("stream", "_run", "island").agg(F.first("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    number = F.row_number().over(W.partitionBy("stream").orderBy("_run", "island"))
    return blocks.withColumn("block", number).select("stream", "block", "speaker", "start_s", "end_s")


def talk_segments(blocks: DataFrame, break_s: float = 60.0, change_s: float = 30.0, dominant: float = 0.7) -> DataFrame:
    """Blocks grouped at gaps over ``break_s``, or of ``change_s`` or more with a speaker change.

    (stream, segment, start_s, end_s, preceding_gap_s, dominant_speaker, kind): a speaker with
    more than ``dominant`` of the time makes it single-speaker, else it is a panel.
    """
    ordered = W.partitionBy("stream").orderBy("block")
    gap = F.col("start_s") - F.lag("end_s").over(ordered)
    cut = (gap > break_s) | ((gap >= change_s) & (F.col("speaker") != F.lag("speaker").over(ordered)))
    rows = blocks.withColumns({"_gap": gap, "_cut": F.when(F.coalesce(cut, F.lit(False)), 1).otherwise(0)})
    rows = rows.withColumn("segment", F.sum("_cut").over(ordered.rowsBetween(*BEFORE)) + 1)
    ends = rows.groupBy("stream", "segment").agg(
        F.min_by("start_s", "block").alias("start_s"), F.max_by("end_s", "block").alias("end_s"), F.coalesce(F.min_by(F.when(F.col("_cut") == 1, F.col("_gap")).otherwise(0.0), "block"), F.lit(0.0)).alias("preceding_gap_s")
    )
    times = speaker_durations(rows)
    top = times.groupBy("stream", "segment").agg(F.max(F.struct("seconds", "speaker")).alias("t"), F.sum("seconds").alias("all"))
    main = F.when(F.col("t.seconds") > dominant * F.col("all"), F.col("t.speaker"))
    top = top.select("stream", "segment", main.alias("dominant_speaker"))
    return ends.join(top, ["stream", "segment"]).withColumn("kind", F.when(F.col("dominant_speaker").isNull(), "panel").otherwise("single-speaker"))


def speaker_durations(rows: DataFrame, keys: tuple[str, ...] = ("stream", "segment")) -> DataFrame:
    return rows.groupBy(*keys, "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))


def dominant_speaker(rows: DataFrame, key: str = "stream", order: str = "event_id") -> DataFrame:
    """The speaker with most rows; the first seen wins ties."""
    counts = rows.groupBy(key, "speaker").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("speaker"), F.max("n").alias("n"))


def speaker_stats(diarization: DataFrame) -> DataFrame:
    return diarization.groupBy("stream", "speaker").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end_s") - F.col("start_s")) / 60, 6).alias("minutes"))


def clip_and_merge(diarization: DataFrame, view_start: float, view_end: float, gap_s: float = 1.0) -> DataFrame:
    """Segments cut to a window, then neighbours of one speaker less than ``gap_s`` apart merged."""
    cut = diarization.where((F.col("end_s") > view_start) & (F.col("start_s") < view_end))
    cut = cut.withColumns({"start_s": F.greatest("start_s", F.lit(view_start)), "end_s": F.least("end_s", F.lit(view_end))})
    return speech_blocks(cut, gap_s)


# fixed values: phrases that speech recognition repeats in silence, as (pattern, name, words)
LOOP_PHRASES = [
    (r"transcription\s+by\s+castingwords", "CastingWords attribution", 3),
    (r"otter\.ai", "otter.ai attribution", 1),
    (r"eso\s+translation", "ESO Translation attribution", 2),
    (r"msword\s+document", "MSWord Document attribution", 2),
    (r"transcription\s+outsourcing", "Transcription Outsourcing attribution", 2),
    (r"uga\s+extension", "UGA Extension attribution", 2),
    (r"thank\s+you\s+for\s+watching", "Thank you for watching", 4),
    (r"fema\.gov", "fema.gov attribution", 1),
    (r"subtitles?\s+by", "subtitle attribution", 2),
    (r"subtitle\s+translation", "subtitle translation", 2),
    (r"closed\s+caption(?:ing|s?)\s+by", "closed captioning attribution", 3),
]


def phrase_loop_zones(words: DataFrame, phrases: list[tuple[str, str, int]] = LOOP_PHRASES, least: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, start_ms, end_ms, pattern): a phrase heard ``least`` times or more, from its first to its last hearing.

    Hits that overlap one another within a phrase's length count once: a hit is
    counted if the count of hits in the words before it, taken greedily, allows.
    """
    longest = max(n for _, _, n in phrases)
    ahead = F.collect_list(F.struct("word", "end_ms")).over(W.partitionBy(key).orderBy("pos").rowsBetween(0, longest - 1))
    # a window's words are joined once for each length of a phrase
    said = {f"_said{n}": F.array_join(F.slice("ahead", 1, n)["word"], " ") for n in sorted({n for _, _, n in phrases})}
    rows = words.select(key, "pos", "start_ms", ahead.alias("ahead")).withColumns(said)
    heard = []
    for pattern, name, n in phrases:
        part = F.slice("ahead", 1, n)
        hit = F.col(f"_said{n}").rlike(f"(?i){pattern}")
        heard.append(F.when(hit, F.struct(F.element_at(part, -1)["end_ms"].alias("end_ms"), F.lit(name).alias("pattern"), F.lit(n).alias("n"))))
    found = rows.select(key, "pos", "start_ms", F.explode(F.array_compact(F.array(*heard))).alias("h")).select(key, "pos", "start_ms", "h.*")
    hits = found.groupBy(key, "pattern", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "start_ms", "end_ms"))).alias("hits"))
    empty = F.filter("hits", lambda h: F.lit(False))
    kept = F.aggregate("hits", empty, lambda a, h: F.when((F.size(a) > 0) & (h["pos"] < F.element_at(a, -1)["pos"] + F.col("n")), a).otherwise(F.concat(a, F.array(h))))
    zones = hits.select(key, "pattern", kept.alias("kept")).where(F.size("kept") >= least)
    return zones.select(key, F.col("kept")[0]["start_ms"].alias("start_ms"), F.element_at("kept", -1)["end_ms"].alias("end_ms"), "pattern")


def may_loop(words: DataFrame, phrases: list[tuple[str, str, int]] = LOOP_PHRASES, least: int = 20, key: str = "doc_id") -> DataFrame:
    """``words`` of the keys in which ``phrase_loop_zones`` or ``zero_run_zones`` may find something: those that have every
    part of a phrase in some word (here: the letters it begins with), or ``least`` zeros. A part without white space lies in
    one word, as words are joined by blanks. The words are read once for it; where few keys are left the others' words
    aren't shuffled."""
    import re

    plain = re.compile(r"(?:[A-Za-z0-9]|\\\.|\(\?:[A-Za-z|?]*\)|[a-z]\?)+")
    parts = [pattern.split(r"\s+") for pattern, _, _ in phrases]
    if not all(plain.fullmatch(x) and x[0].isalnum() for each in parts for x in each):
        return words  # a phrase whose parts aren't known
    stem = lambda x: (m := re.match(r"[A-Za-z0-9]+", x).group())[: len(m) - x[len(m) :].startswith("?")].lower()
    parts = [[stem(x) for x in each] for each in parts]
    names = {x: f"_p{k}" for k, x in enumerate(dict.fromkeys(x for each in parts for x in each))}
    rows = words.select(key, F.lower("word").alias("_low"), (F.trim("word") == "0").alias("_zero"))
    anything = F.col("_zero")
    for x in names:
        anything = anything | F.contains("_low", F.lit(x))
    counts = rows.where(anything).groupBy(key).agg(F.count_if("_zero").alias("_zeros"), *[F.max(F.contains("_low", F.lit(x))).alias(n) for x, n in names.items()])
    heard = F.lit(False)
    for each in parts:
        whole = F.lit(True)
        for x in each:
            whole = whole & F.col(names[x])
        heard = heard | whole
    return of_keys(words, counts.where(heard | (F.col("_zeros") >= least)), [key])


def run_zones(words: DataFrame, is_member: Column, least: int = 20, gap_ms: int = 5000, key: str = "doc_id", name: str = "numeric zero loop") -> DataFrame:
    """Runs of ``least`` or more consecutive member words, broken by a gap over ``gap_ms``."""
    ordered = W.partitionBy(key).orderBy("pos")
    rows = words.withColumn("_m", is_member)
    new = ~F.lag("_m").over(ordered) | (F.col("start_ms") - F.lag("end_ms").over(ordered) > gap_ms)
    rows = rows.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum(F.when(F.col("_m"), F.col("_new")).otherwise(0)).over(ordered.rowsBetween(*BEFORE)))
    runs = rows.where("_m").groupBy(key, "_run").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(key, "start_ms", "end_ms", F.lit(name).alias("pattern"))


def zero_run_zones(words: DataFrame, key: str = "doc_id") -> DataFrame:
    return run_zones(words, F.trim("word") == "0", key=key)


def silence_mismatch_zones(words: DataFrame, diarization: DataFrame, gap_s: float = 60.0, size: float = 300.0) -> DataFrame:
    """Words (stream, start_s, end_s) wholly inside a diarization gap of ``gap_s`` or more: a zone from the first to the last."""
    ordered = W.partitionBy("stream").orderBy(*SPEECH)
    gaps = diarization.select("stream", F.col("end_s").alias("gap_start"), F.lead("start_s").over(ordered).alias("gap_end"), F.row_number().over(ordered).alias("gap"))
    gaps = small(written(gaps.where(F.col("gap_end") - F.col("gap_start") >= gap_s), "gaps"))
    inside = containment_join(words, gaps, ["stream"], "start_s", "end_s", "gap_start", "gap_end", size)
    return inside.groupBy("stream", "gap").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "start_s").alias("end_s")).select("stream", "start_s", "end_s", F.lit("diarization silence mismatch").alias("pattern"))


def merge_zones(zones: DataFrame, key: str, start: str, end: str, within: float = 60.0) -> DataFrame:
    """Zones within ``within`` of one another as one, their patterns joined in order without repeats."""
    rows = islands(zones, [key], start, end, within=within, order=["pattern"])
    return rows.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sort_array(F.collect_list(F.struct(start, "pattern"))).alias("_p")).select(
        key, start, end, F.array_join(F.array_distinct(F.transform("_p", lambda p: p["pattern"])), "; ").alias("pattern")
    )


def low_confidence_zones(asr: DataFrame, logprob: float = -1.0, no_speech: float = 0.5, least_s: float = 30.0) -> DataFrame:
    """Runs of segments with a low log-probability or a high no-speech probability, longer than ``least_s``."""
    ordered = W.partitionBy("stream").orderBy(*SPEECH)
    bad = (F.col("avg_logprob") < logprob) | (F.col("no_speech_prob") > no_speech)
    rows = asr.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(ordered.rowsBetween(*BEFORE)))
    runs = rows.where("_bad").groupBy("stream", "_run").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", F.struct(*SPEECH)).alias("end_s"))
    return runs.where(F.col("end_s") - F.col("start_s") > least_s).select("stream", "start_s", "end_s")


def usable_start(words: DataFrame, window: int = 20, least: int = 12, key: str = "doc_id") -> DataFrame:
    """Start of the first full window of ``window`` words with ``least`` distinct ones (lower case)."""
    ahead = W.partitionBy(key).orderBy("pos").rowsBetween(0, window - 1)
    rows = words.select(key, "pos", "start_ms", F.size(F.collect_set(F.lower("word")).over(ahead)).alias("distinct"), F.count("*").over(ahead).alias("n"))
    good = rows.where((F.col("n") == window) & (F.col("distinct") >= least))
    return good.groupBy(key).agg(F.min_by("start_ms", "pos").alias("start_ms"), F.min("pos").alias("pos"))


def fill_end_times(rows: DataFrame, key: str, start: str, end: str, order: list[str]) -> DataFrame:
    """A missing or zero end becomes the next start; the last stays open."""
    following = F.lead(start).over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn(end, F.coalesce(F.when(F.col(end) != 0, F.col(end)), following))


def best_match_per_talk(matches: DataFrame, key: str = "talk", score: str = "confidence", start: str = "start_s") -> DataFrame:
    """The match of highest confidence, then earliest start, of each talk."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), start))
    return matches.withColumn("_place", place).where("_place = 1").drop("_place")


def token_chunks(words: DataFrame, size: int = 2000, key: str = "doc_id") -> DataFrame:
    """Records of ``size`` words: (key, chunk, n, text, start_ms, end_ms)."""
    rows = words.withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))
    one = F.sort_array(F.collect_list(F.struct("pos", "word")))
    out = rows.groupBy(key, "chunk").agg(F.count("*").alias("n"), one.alias("_w"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.select(key, "chunk", "n", F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("text"), "start_ms", "end_ms")


def anchored_time_chunks(words: DataFrame, span_ms: int = 900_000, key: str = "doc_id") -> DataFrame:
    """(key, chunk, anchor_ms, n): a chunk begins at its own first word and ends before a word ``span_ms`` or more later.

    A fold over a key's starts, since each anchor depends on the one before.
    """
    starts = words.groupBy(key).agg(F.sort_array(F.collect_list("start_ms")).alias("s"))
    zero = F.expr("cast(array() as array<struct<anchor: bigint, n: bigint>>)")

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        more = F.struct(last["anchor"].alias("anchor"), (last["n"] + 1).alias("n"))
        fresh = F.struct(s.alias("anchor"), F.lit(1).cast("long").alias("n"))
        return F.when((F.size(a) == 0) | (s - F.try_element_at(a, F.lit(-1))["anchor"] >= span_ms), F.concat(a, F.array(fresh))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(more)))

    return starts.select(key, F.posexplode(F.aggregate("s", zero, step)).alias("chunk", "c")).select(key, "chunk", F.col("c.anchor").alias("anchor_ms"), F.col("c.n").alias("n"))


def transcript_manifest(words: DataFrame, bucket_ms: int = 300_000, key: str = "doc_id") -> DataFrame:
    """Words in each fixed bucket from 0 to the last word's end, empty ones too; the last bucket is clipped to that end."""
    counts = words.groupBy(key, F.floor(F.col("start_ms") / bucket_ms).alias("bucket")).agg(F.count("*").alias("n"))
    ends = words.groupBy(key).agg(F.max("end_ms").alias("_end"))
    spine = ends.select(key, "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_end") - 1) / bucket_ms))).alias("bucket"))
    rows = spine.join(counts, [key, "bucket"], "left")
    return rows.select(key, "bucket", (F.col("bucket") * bucket_ms).alias("from_ms"), F.least((F.col("bucket") + 1) * bucket_ms, F.col("_end")).alias("to_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def speech_density(diarization: DataFrame, length_s: float, bins: int = 48) -> DataFrame:
    """(stream, bin, density): seconds of speech over the bin's length, for equal bins of [0, length_s)."""
    size = length_s / bins
    cut = diarization.where((F.col("start_s") < length_s) & (F.col("end_s") > 0))
    rows = cut.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest("start_s", F.lit(0.0)) / size), F.least(F.floor(F.col("end_s") / size), F.lit(bins - 1)))))
    part = F.least(F.col("end_s"), (F.col("bin") + 1) * size) - F.greatest(F.col("start_s"), F.col("bin") * size)
    return rows.groupBy("stream", "bin").agg(F.round(F.sum(F.greatest(part, F.lit(0.0))) / size, 6).alias("density")).where("density > 0")


def merge_anchored_comments(comments: DataFrame, key: str = "subject_uri") -> DataFrame:
    """Anchored comments whose byte ranges touch, as groups: range, number of emoji and of texts."""
    from spanloom.functions.text import is_emoji_reaction

    rows = islands(comments.where("byte_start is not null"), [key], "byte_start", "byte_end", order=["uri"])
    return rows.groupBy(key, "island").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.count_if(is_emoji_reaction(F.col("text"))).alias("emoji"), F.count_if(~is_emoji_reaction(F.col("text"))).alias("texts"))


def boundary_clamp(rows: DataFrame, key: str, order: list[str], least_s: float = 1.0) -> DataFrame:
    """Proposed edges (new_start_s, new_end_s) limited by 0, the neighbours' edges and the row's other edge +- ``least_s``."""
    ordered = W.partitionBy(key).orderBy(*order)
    floor = F.coalesce(F.lag("end_s").over(ordered), F.lit(0.0))
    top = F.lead("start_s").over(ordered)
    start = F.greatest(floor, F.lit(0.0), F.least("new_start_s", F.col("end_s") - least_s))
    end = F.greatest("new_end_s", F.col("start_s") + least_s)
    return rows.withColumns({"clamped_start_s": start, "clamped_end_s": F.when(top.isNotNull(), F.least(end, top)).otherwise(end)})


def first_rows(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group under an explicit order."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def topic_breaks(sentences: DataFrame, width: int = 3, below: float = 0.3, apart: int = 5, least: int = 6, key: str = "doc") -> DataFrame:
    """(key, ordinal, similarity): cosine of the mean vectors of ``width`` sentences before and from a sentence is under
    ``below``, breaks at least ``apart`` sentences apart, earliest first. ``sentences``: (key, ordinal from 0, vector)."""
    n = F.count("*").over(W.partitionBy(key))
    long = sentences.withColumn("_n", n).where(F.col("_n") >= least).select(key, "ordinal", "_n", F.posexplode("vector").alias("dim", "x"))
    ordered = W.partitionBy(key, "dim").orderBy("ordinal")
    sides = long.select(key, "ordinal", "_n", F.avg("x").over(ordered.rowsBetween(-width, -1)).alias("a"), F.avg("x").over(ordered.rowsBetween(0, width - 1)).alias("b"))
    inner = sides.where((F.col("ordinal") >= width) & (F.col("ordinal") <= F.col("_n") - width))
    sums = inner.groupBy(key, "ordinal").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    low = sums.select(key, "ordinal", F.round(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), 6).alias("similarity")).where(F.col("similarity") < below)
    each = low.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "similarity"))).alias("s"))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), lambda a, x: F.when((F.size(a) == 0) | (x["ordinal"] - F.try_element_at(a, F.lit(-1))["ordinal"] >= apart), F.concat(a, F.array(x))).otherwise(a))
    return each.select(key, F.explode(kept).alias("k")).select(key, "k.ordinal", "k.similarity")


def sentence_rows(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, byte_start, byte_end, text): split after . ! or ? and white space; bytes by sums of lengths."""
    parts = documents.select(key, F.posexplode(F.split(F.col("text"), r"(?<=[.!?])(?=\s)")).alias("ordinal", "piece"))
    upto = W.partitionBy(key).orderBy("ordinal").rowsBetween(*BEFORE)
    end = F.sum(F.octet_length("piece")).over(upto)
    lead = F.octet_length(F.regexp_extract("piece", r"^\s*", 0))
    rows = parts.select(key, "ordinal", (end - F.octet_length("piece") + lead).alias("byte_start"), end.alias("byte_end"), F.regexp_replace("piece", r"^\s+", "").alias("text"))
    return rows.where("text <> ''")


def sentence_places(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, byte_start, byte_end): the places of ``sentence_rows``, numbered from 0, without their texts. They are made
    in the text's row, so no text is shuffled."""

    def cut(batches):
        import re

        import pyarrow as pa

        space = " \t\n\x0b\f\r"
        ends = re.compile(rf"(?<=[.!?])(?=[{space}])")
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = n = 0
                for piece in ends.split(text or ""):
                    size, bare = len(piece.encode()), piece.lstrip(space)
                    if bare:
                        rows.append((i, n, at + len(piece) - len(bare), at + size))
                        n += 1
                    at += size
            row, *places = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(p, pa.int64()) for p in places]], names=[key, "ordinal", "byte_start", "byte_end"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col("text").cast("string")).mapInArrow(cut, f"{key} {kind}, ordinal long, byte_start long, byte_end long")


def replace_in_zones(words: DataFrame, zones: DataFrame, new: DataFrame, key: str = "doc_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, pos, word, start, end): words that overlap a zone (key, start, end) give way to the ``new`` words (key, word,
    start, end), and all are numbered again in the order of their starts; on ties old words come first, in their order.

    Words, new words and zones come to their key in one shuffle. A word overlaps a zone if the largest end of the zones
    that start before its end lies behind its start.
    """
    row = lambda rows, kind, pos, word: rows.select(key, F.lit(kind).alias("_new"), pos.cast("long").alias("_pos"), word.cast("string").alias("word"), start, end)
    spans = zones.where(F.col(key).isNotNull() & F.col(start).isNotNull())
    rows = row(words, 0, F.col("pos"), F.col("word")).unionByName(row(new, 1, F.lit(0), F.col("word"))).unionByName(row(spans, 2, F.lit(0), F.lit(None))).repartition(key)
    zone = F.col("_new") == 2
    before = W.partitionBy(key).orderBy(F.when(zone, F.col(start)).otherwise(F.col(end)), "_new").rowsBetween(*BEFORE)
    rows = rows.withColumn("_far", F.max(F.when(zone, F.col(end))).over(before))
    both = rows.where((F.col("_new") == 1) | ((F.col("_new") == 0) & ~F.coalesce(F.col("_far") > F.col(start), F.lit(False))))
    place = F.row_number().over(W.partitionBy(key).orderBy(start, "_new", "_pos", end, "word")) - 1
    return both.select(key, place.cast("int").alias("pos"), "word", start, end)


def _chunks_of_zones(start, end, zones, gap_s: float, most_s: float):
    """For zones (a, b) in the order of a: lists of chunks (start, end) of the segments given in order as arrays.

    Segments that start in a zone are a slice, and their blocks those of the whole stream but for the ends, so a zone costs
    its blocks, not its segments. Of the segments that reach into it only the last one counts; a stack holds those that may
    be. Where a segment or zone ends before it starts, a zone looks at all segments.
    """
    import numpy as np

    fresh = np.flatnonzero(start[1:] - end[:-1] >= gap_s) + 1
    odd = bool((end <= start).any()) or any(b <= a for a, b in zones)
    reach, done = [], 0  # segments whose end no later one's reaches
    for a, b in zones:
        if odd:
            own = np.flatnonzero((start < b) & (end > a))
            s, e = np.maximum(start[own], a), np.minimum(end[own], b)
            first = np.append(0, np.flatnonzero(s[1:] - e[:-1] >= gap_s) + 1) if len(own) else own
            blocks = [(s[i], e[j - 1]) for i, j in zip(first, np.append(first[1:], len(own))[: len(first)], strict=True)]
        else:
            lo, hi = np.searchsorted(start, [a, b])
            for i in range(done, lo):
                while reach and end[reach[-1]] <= end[i]:
                    reach.pop()
                reach.append(i)
            done = max(done, int(lo))
            while reach and end[reach[-1]] <= a:
                reach.pop()
            cuts = fresh[np.searchsorted(fresh, lo, "right") : np.searchsorted(fresh, hi)]
            first, last = np.append(lo, cuts), np.append(cuts, hi) - 1
            blocks = list(zip(start[first], np.minimum(end[last], b), strict=True)) if lo < hi else []
            if reach:
                e = min(end[reach[-1]], b)
                blocks = [(a, blocks[0][1]), *blocks[1:]] if blocks and blocks[0][0] - e < gap_s else [(a, e), *blocks]
        out = []
        for s, e in blocks:
            if out and e - out[-1][0] <= most_s:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
        yield out


def zone_speech_chunks(zones: DataFrame, diarization: DataFrame, gap_s: float = 5.0, most_s: float = 1200.0) -> DataFrame:
    """(stream, zone, chunk, start_s, end_s): speech inside a zone (stream, zone, zone_start, zone_end), clamped to it,
    joined at gaps under ``gap_s`` and packed in order into spans of at most ``most_s``; a longer block stays whole.

    A stream's segments are shuffled and sorted once, and no pair of a zone and a segment is made (``_chunks_of_zones``).
    Zones of one start and end are looked at once. A stream's segments must fit in a Python worker, three numbers each.
    """
    key = ["stream", "zone_start", "zone_end"]
    number = lambda c: F.col(c).cast("double").alias(c)
    asked = zones.select(*key).distinct().dropna()
    heard = diarization.select("stream", F.col("event_id"), number("start_s"), number("end_s")).dropna(subset=["stream", "start_s", "end_s"])

    def chunked(segments, own):
        import pyarrow as pa
        import pyarrow.compute as pc

        segments = segments.take(pc.sort_indices(segments, sort_keys=[("start_s", "ascending"), ("event_id", "ascending")], null_placement="at_start"))
        start, end = (segments.column(c).to_numpy() for c in ("start_s", "end_s"))
        own = own.sort_by("zone_start")
        bounds = list(zip(own.column("zone_start").cast("double").to_pylist(), own.column("zone_end").cast("double").to_pylist(), strict=True))
        rows = [(n, k, float(s), float(e)) for n, found in enumerate(_chunks_of_zones(start, end, bounds, gap_s, most_s)) for k, (s, e) in enumerate(found)]
        at, chunk, s, e = zip(*rows, strict=True) if rows else ((),) * 4
        out = own.select(key).take(pa.array(at, pa.int64()))
        for name, column in (("chunk", pa.array(chunk, pa.int32())), ("start_s", pa.array(s, pa.float64())), ("end_s", pa.array(e, pa.float64()))):
            out = out.append_column(name, column)
        return out

    kinds = dict(zones.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in key], "chunk int", "start_s double", "end_s double"])
    chunks = heard.groupBy("stream").cogroup(asked.groupBy("stream")).applyInArrow(chunked, schema)
    return zones.select("zone", *key).distinct().join(chunks, key).select("stream", "zone", "chunk", "start_s", "end_s")
