"""Tables of a catalogue: a matched schedule as records, the index with its cross references, a stream's page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import slugify, tokenize_name
from spanloom.sources.files import written

from .sequence import fill_end_times, first_rows


def ingest_tables(matches: DataFrame, did: str) -> dict[str, DataFrame]:
    """talks, speakers, links and status of a matched schedule.

    ``matches``: (place, uri, title, room, category, starts_at, ends_at, vod_uri,
    offset_ns, coverage_ms, speakers array of (id, name)). A talk's key is the
    end of its uri; a speaker's is the id as a slug, with the name seen first by
    (place, position). Without a recording, offset and duration are 0.
    """
    base = lambda kind, key: F.concat(F.lit(f"at://{did}/{kind}/"), key)
    rows = matches.withColumn("rkey", F.element_at(F.split("uri", "/"), -1)).withColumn("talk_uri", base("talk", F.col("rkey")))
    found = F.col("vod_uri").isNotNull()
    talks = rows.select(
        F.col("talk_uri").alias("uri"), "rkey", "title", "room", "category", "starts_at", "ends_at", "vod_uri", F.when(found, F.coalesce("offset_ns", F.lit(0))).otherwise(0).cast("long").alias("offset_ns"),
        F.col("uri").alias("schedule_uri"), F.when(found, F.round(F.col("coverage_ms") * 1e6)).otherwise(0).cast("long").alias("duration_ns"),
    )
    heard = rows.select("talk_uri", "place", F.posexplode("speakers").alias("position", "s")).select("talk_uri", "place", "position", "s.id", "s.name")
    speakers = heard.groupBy("id").agg(F.min_by("name", F.struct("place", "position")).alias("name")).withColumn("rkey", slugify(F.col("id")))
    speakers = speakers.select(base("speaker", F.col("rkey")).alias("uri"), "rkey", "name", F.col("id").alias("handle"))
    links = heard.select("talk_uri", base("speaker", slugify(F.col("id"))).alias("speaker_uri")).distinct()
    return {"talks": talks, "speakers": speakers, "links": links, "status": rows.select("talk_uri", F.lit(1).alias("ingested"))}


def enrich_index(entries: DataFrame, concepts: DataFrame, concept_talks: DataFrame, least: int = 3, subentries: int = 3, talks: int = 5, also: int = 5) -> DataFrame:
    """(term, role, place, label, talks, n): the index with its cross references, one row an item.

    ``entries`` (term, proper, talk, n), ``concepts`` (uri, name, aliases),
    ``concept_talks`` (concept_uri, talk). Roles: entry (its ``talks`` first
    talks outside all subentries, n mentions in all), subentry (a concept one of
    whose names holds the term, for terms of ``least`` talks or more: three of
    the talks they share), see (the concept with this alias), see also (terms in
    two or more of the same concepts' names), inversion ("Last, First" of a
    proper term). Talks go by mentions, then key. Entries of several words that
    are some subentry's label are left out.

    A concept's few words are paired, never a term's documents; tops per term
    are windows with a limit, which Spark cuts before the shuffle.
    """
    best = [F.desc("n"), "talk"]
    top = lambda rows, keys, order, most: rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
    listed = lambda rows, keys: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "talk"))), lambda t: t["talk"]).alias("talks"))
    entries = written(entries, "entries")
    terms = entries.groupBy("term").agg(F.count("*").alias("talks_n"), F.sum("n").alias("n"), F.max("proper").alias("proper"))
    terms = written(terms, "terms")
    names = concepts.select("uri", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("said"))
    related = names.select(F.explode(tokenize_name(F.col("said"))).alias("term"), "uri", "name").distinct()

    reached = related.join(concept_talks.select(F.col("concept_uri").alias("uri"), "talk").distinct(), "uri")
    # an entry with its concepts that share a talk: read once for the subentries and once for the talks outside them
    shared = written(entries.join(reached, ["term", "talk"]).join(terms.where(F.col("talks_n") >= least).select("term"), "term", "left_semi"), "shared")
    subs = listed(top(shared, ["term", "uri", "name"], best, 3), ["term", "uri", "name"])
    subs = top(subs, ["term"], [F.desc(F.size("talks")), "uri"], subentries).select("term", F.lit("subentry").alias("role"), "place", F.col("name").alias("label"), "talks", F.size("talks").cast("long").alias("n"))
    subs = written(subs, "subentries")
    open_talks = entries.join(shared.select("term", "talk").distinct(), ["term", "talk"], "left_anti")
    own = terms.join(listed(top(open_talks, ["term"], best, talks), ["term"]), "term", "left")
    none = F.lit(None).cast("string")
    empty = F.slice(F.col("talks"), 1, 0)
    own = own.select("term", F.lit("entry").alias("role"), F.lit(0).alias("place"), none.alias("label"), "talks", "n")

    aliases = concepts.select(F.explode("aliases").alias("a"), "uri", "name").groupBy(F.lower("a").alias("term")).agg(F.max_by("name", "uri").alias("label"))
    see = terms.join(aliases, "term").select("term", F.lit("see").alias("role"), F.lit(1).alias("place"), "label")
    known = related.join(terms.select("term"), "term", "left_semi").select("term", "uri")
    pairs = known.join(known.withColumnRenamed("term", "label"), "uri").where("term <> label").groupBy("term", "label").agg(F.count("*").alias("c")).where("c >= 2")
    others = top(pairs, ["term"], [F.desc("c"), "label"], also).select("term", F.lit("see also").alias("role"), "place", "label")
    parts = F.split("term", r"\s+")
    turned = terms.where(F.col("proper") & (F.size(parts) >= 2)).select(F.concat(F.array_join(F.slice(parts, 2, F.size(parts)), " "), F.lit(", "), parts[0]).alias("inverted"), F.col("term").alias("label"))
    turned = turned.groupBy(F.lower("inverted").alias("_low")).agg(F.min_by("inverted", "label").alias("term"), F.min("label").alias("label"))
    turned = turned.join(terms.select(F.lower("term").alias("_low")), "_low", "left_anti").select("term", F.lit("inversion").alias("role"), F.lit(1).alias("place"), "label")

    rows = own.unionByName(subs)
    rows = rows.unionByName(see.unionByName(others).unionByName(turned), allowMissingColumns=True)
    rows = rows.withColumns({"talks": F.coalesce("talks", empty, F.array()), "n": F.coalesce("n", F.lit(0))})
    labels = subs.where(F.contains("label", F.lit(" "))).select(F.lower("label").alias("_low")).distinct()
    return rows.withColumn("_low", F.lower("term")).join(labels, "_low", "left_anti").drop("_low")


def track_detail(streams: DataFrame, talks: DataFrame, diarization: DataFrame, words: DataFrame, spans: DataFrame) -> DataFrame:
    """(stream, part, start, end, label) of every known stream: its name and length, its talks (stream, talk, start_s,
    end_s; a missing end is the next start), speech, words (seconds) and text spans (stream, kind, byte_start, byte_end).

    A long table, as a stream's page has megabytes of words; pages are cut by stream and part at the sink.
    """
    filled = fill_end_times(talks, "stream", "start_s", "end_s", ["start_s", "talk"])
    part = lambda rows, kind, a, b, label: rows.select("stream", kind.alias("part"), F.col(a).cast("double").alias("start"), F.col(b).cast("double").alias("end"), F.col(label).cast("string").alias("label"))
    rows = part(filled, F.lit("talk"), "start_s", "end_s", "talk").union(part(diarization, F.lit("speech"), "start_s", "end_s", "speaker"))
    rows = rows.union(part(words, F.lit("word"), "start_s", "end_s", "word")).union(part(spans.withColumn("_l", F.lit(None)), F.col("kind"), "byte_start", "byte_end", "_l"))
    head = first_rows(streams, ["stream"], ["name"])
    return part(head.withColumn("_z", F.lit(0.0)), F.lit("stream"), "_z", "duration_s", "name").union(rows.join(head.select("stream"), "stream", "left_semi"))
