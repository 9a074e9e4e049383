"""Typed tables of the record collections: one parse of the JSON a record, one column a field."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = object()


class Field(NamedTuple):
    """A column, the record's fields it comes from (the first that is set), its type ("json": text of a nested value)
    and what an absent or empty (``''``, 0) value becomes; KEEP leaves such values as they are."""

    column: str
    fields: tuple[str, ...]
    kind: str = "string"
    empty: object = KEEP


def _text(column: str, field: str | None = None, empty: object = KEEP) -> Field:
    return Field(column, (field or column,), "string", empty)


# fixed values: the columns of each collection's table and the record fields behind them
COLLECTIONS = {
    "event": [
        _text("name"), _text("description", empty=None), _text("location", empty=None), _text("starts_at", "startsAt"), _text("ends_at", "endsAt"),
        Field("tracks", ("tracks",), "json"), _text("schedule_repo", "scheduleRepo", None), _text("vod_repo", "vodRepo", None),
    ],
    "talk": [
        _text("title"), _text("description", empty=None), _text("video_uri", "videoUri", None), Field("video_offset_ns", ("videoOffsetNs",), "long", 0),
        Field("video_segments", ("videoSegments",), "json"), _text("schedule_uri", "scheduleUri", None), _text("event_uri", "eventUri", None), _text("room", empty=None),
        _text("category", empty=None), _text("talk_type", "talkType", None), _text("starts_at", "startsAt", None), _text("ends_at", "endsAt", None),
        Field("duration", ("duration",), "long", 0), Field("document", ("document",), "json"),
    ],
    "speaker": [_text("name"), _text("handle", empty=None), _text("speaker_did", "did", None), _text("bio", empty=None), Field("affiliations", ("affiliations",), "json")],
    "concept": [_text("name"), Field("aliases", ("aliases",), "json"), _text("description", empty=None), _text("wikidata_id", "wikidataId", None), _text("url", empty=None)],
    "transcript": [_text("talk_uri", "talkUri"), _text("text"), Field("start_ms", ("startMs",), "long"), Field("timings", ("timings",), "json")],
    "comment": [
        _text("subject_uri", "subject"), _text("text"), Field("facets", ("facets",), "json"), Field("byte_start", ("anchor.byteStart",), "long"),
        Field("byte_end", ("anchor.byteEnd",), "long"), _text("created_at", "createdAt"),
    ],
    "stream": [
        _text("name"), _text("slug"), _text("room"), _text("day_label", "dayLabel"), _text("stream_video_uri", "streamVideoUri"),
        Field("duration_seconds", ("durationSeconds",), "long"),
    ],
    "stream_transcript": [
        _text("stream_uri", "streamUri"), Field("chunk_index", ("chunkIndex",), "long", 0), _text("text"), Field("start_ms", ("startMs",), "long"),
        Field("timings", ("timings",), "json"),
    ],
    "stream_diarization": [
        _text("stream_uri", "streamUri"), Field("chunk_index", ("chunkIndex",), "long", 0), Field("segments", ("segments",), "json"),
        Field("speaker_count", ("speakerCount",), "long"),
    ],
    "lens": [_text("source_nsid", "source", None), _text("target_nsid", "target", None), Field("version", ("version",), "long", 1), Field("chain_json", ("specJson", "chainJson"), "json")],
    "expression": [_text("transcript_uri", "sourceRef", ""), _text("text", empty=""), _text("language", empty="en"), _text("created_at", "createdAt", "now")],
    "segmentation": [_text("expression_uri", "expression", ""), Field("tokens_json", ("tokenizations",), "json"), _text("created_at", "createdAt", "now")],
    "annotation_layer": [
        _text("expression_uri", "expression", ""), _text("kind", empty=""), _text("subkind", empty=""), Field("annotations_json", ("annotations",), "json"),
        _text("created_at", "createdAt", "now"),
    ],
}


def record_schema(collection: str) -> str:
    """The DDL of a collection's records; fields of one parent nest under it."""
    flat, nested = {}, {}
    for f in COLLECTIONS[collection]:
        for path in f.fields:
            kind = "string" if f.kind == "json" else f.kind
            parent, _, leaf = path.rpartition(".")
            (nested.setdefault(parent, {}) if parent else flat)[leaf] = kind
    ddl = [f"`{n}` {k}" for n, k in flat.items()]
    ddl += [f"`{p}` struct<{', '.join(f'{n}: {k}' for n, k in inner.items())}>" for p, inner in nested.items()]
    return ", ".join(ddl)


def project_collection(rows: DataFrame, collection: str, keep: tuple[str, ...] = ("uri", "did", "rkey"), now: str = "") -> DataFrame:
    """``keep`` and the typed columns of a collection's ``record``. Records that don't parse give the columns of an
    empty record; ``now`` stands for a missing time of creation."""
    parsed = rows.select(*keep, F.from_json("record", record_schema(collection)).alias("_r"))
    out = []
    for f in COLLECTIONS[collection]:
        value = F.coalesce(*[F.col(f"_r.{path}") for path in f.fields])
        if f.empty is not KEEP:
            bare = F.nullif(value, F.lit(0 if f.kind == "long" else ""))
            value = bare if f.empty is None else F.coalesce(bare, F.lit(now if f.empty == "now" else f.empty))
        out.append(value.alias(f.column))
    return parsed.select(*keep, *out)
