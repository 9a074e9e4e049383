"""Documents rebuilt from the commit stream, by a stateful operator keyed by expression.

The state of an expression is the newest commit of each of its records (the
expression with its text, segmentations with tokens and times, annotation layers),
so records may come in any order, repeatedly and in any number of batches.
Whenever they change and an expression has its text, a segmentation and a layer,
its records are emitted; the document is put together from them in the row, with
native functions, as ``document_spans`` of a batch would be. An expression that
loses a part it needs is emitted without a document, so the newest row of each
expression is always what a batch over all commits gives.

Records: expression {text}; segmentation {expression, tokens [[pos, byte_start,
byte_end]], times [[pos, start_ms, end_ms]]}; annotationLayer {expression, subkind,
annotations [{kind, byteStart, byteEnd, value}]}. Tokens meet times by number
within a record. A delete names only the record; ``known`` (uri, expression) finds
its expression. Needs the RocksDB state store, which ``rebuild_stream`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORDS = "array<struct<uri: string, collection: string, record: string>>"
OUT = f"expression string, seq long, records {RECORDS}"
SEGMENTS = "tokens array<array<bigint>>, times array<array<bigint>>"
LAYER = "annotations array<struct<kind: string, byteStart: bigint, byteEnd: bigint, value: string>>"


def keyed_commits(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(expression, uri, collection, time_us, rev, record) of commits of expressions and their parts; deletes have a null record."""
    own = F.col("collection").endswith("expression")
    named = F.when(own, F.col("uri")).otherwise(F.get_json_object("record", "$.expression"))
    rows = commits.where(own | F.col("collection").endswith("segmentation") | F.col("collection").endswith("annotationLayer"))
    if known is not None:
        rows = rows.join(known.select("uri", F.col("expression").alias("_known")), "uri", "left")
        named = F.coalesce(named, "_known")
    record = F.when(F.col("operation") != "delete", F.col("record"))
    return rows.select(named.alias("expression"), "uri", "collection", "time_us", F.col("rev").cast("string").alias("rev"), record.alias("record")).where("expression is not null")


def _ready(collections: list[str]) -> bool:
    return all(any(c.endswith(kind) for c in collections) for kind in ("expression", "segmentation", "annotationLayer"))


class Rebuild(StatefulProcessor):
    """Keeps the newest commit of each record of an expression; emits all of them when they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "uri string", "collection string, time_us long, rev string, record string")
        self.emitted = handle.getValueState("emitted", "seq long, full boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        changed = False
        for pdf in rows:
            for uri, collection, time_us, rev, record in zip(*(pdf[c] for c in ("uri", "collection", "time_us", "rev", "record")), strict=True):
                new = (collection, int(time_us), rev if isinstance(rev, str) else "", record if isinstance(record, str) else None)
                old = self.records.getValue((uri,)) if self.records.containsKey((uri,)) else None
                if old is None or (old[1], old[2]) < new[1:3]:
                    self.records.updateValue((uri,), new)
                    changed = True
        if not changed:
            return
        live = sorted((k[0], v[0], v[3]) for k, v in self.records.iterator() if v[3] is not None)
        full = _ready([c for _, c, _ in live])
        seq, was = self.emitted.get() if self.emitted.exists() else (0, False)
        if full or was:
            self.emitted.update((seq + 1, full))
            found = [{"uri": u, "collection": c, "record": r} for u, c, r in live] if full else None
            yield pd.DataFrame({"expression": [key[0]], "seq": [seq + 1], "records": [found]})

    def close(self) -> None:
        pass


def rebuild_stream(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(expression, seq, text, facets) as they change, of a stream of commits; text and facets are null where a needed part has gone."""
    commits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = keyed_commits(commits, known).groupBy("expression").transformWithStateInPandas(Rebuild(), OUT, "Append", "None")
    return rows.select("expression", "seq", document_text(F.col("records")).alias("text"), document_facets(F.col("records")).alias("facets"))


def newest_documents(rows: DataFrame) -> DataFrame:
    """(expression, text, facets): the last state of each expression that has a document."""
    last = rows.groupBy("expression").agg(F.max_by(F.struct("text", "facets"), "seq").alias("d"))
    return last.where("d.facets is not null").select("expression", "d.text", "d.facets")


def documents_of(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(expression, text, facets): the same of a table of commits, in one aggregation."""
    newest = keyed_commits(commits, known).withColumn("_n", F.row_number().over(W.partitionBy("expression", "uri").orderBy(F.desc("time_us"), F.desc("rev"))))
    live = newest.where("_n = 1 and record is not null").groupBy("expression").agg(F.sort_array(F.collect_list(F.struct("uri", "collection", "record"))).alias("records"))
    has = lambda kind: F.exists("records", lambda r: r["collection"].endswith(kind))
    live = live.where(has("expression") & has("segmentation") & has("annotationLayer"))
    return live.select("expression", document_text(F.col("records")).alias("text"), document_facets(F.col("records")).alias("facets"))


def _of(records: Column, kind: str) -> Column:
    return F.filter(records, lambda r: r["collection"].endswith(kind))


def document_text(records: Column) -> Column:
    return F.get_json_object(_of(records, "expression")[0]["record"], "$.text")


def document_facets(records: Column) -> Column:
    """Facets (byte_start, byte_end, kind, value) in order of place, kind and value: timed tokens and annotations."""

    def stamps(r: Column) -> Column:
        part = F.from_json(r["record"], SEGMENTS)
        sided = lambda a, side: F.transform(F.coalesce(a, F.expr("cast(array() as array<array<bigint>>)")), lambda t: F.concat(F.array(t[0], F.lit(side).cast("long")), F.slice(t, 2, 2)))
        # sorted by number, a token is followed by its time
        both = F.sort_array(F.concat(sided(part["tokens"], 0), sided(part["times"], 1)))
        return F.transform(F.array(both), lambda a: F.filter(F.transform(a, lambda t, i: F.when((t[1] == 0) & (F.get(a, i + 1)[0] == t[0]) & (F.get(a, i + 1)[1] == 1), F.struct(t[2].alias("byte_start"), t[3].alias("byte_end"), F.lit("timestamp").alias("kind"), F.concat_ws("-", (F.get(a, i + 1)[2] * 1_000_000).cast("string"), (F.get(a, i + 1)[3] * 1_000_000).cast("string")).alias("value")))), lambda x: x.isNotNull()))[0]

    def notes(r: Column) -> Column:
        return F.transform(F.coalesce(F.from_json(r["record"], LAYER)["annotations"], F.expr(f"cast(array() as {LAYER.removeprefix('annotations ')})")), lambda a: F.struct(a["byteStart"].alias("byte_start"), a["byteEnd"].alias("byte_end"), a["kind"].alias("kind"), a["value"].alias("value")))

    timed, noted = F.flatten(F.transform(_of(records, "segmentation"), stamps)), F.flatten(F.transform(_of(records, "annotationLayer"), notes))
    return F.sort_array(F.concat(timed, noted))
