"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources, by code point with null
last, weigh 1, 2, 3, repeating, and share all sizes by weight; no target may
pass ``most`` times its source's size, and what is cut is shared again.

Of all document rates r (0 to ``most``) that meet a source's target, the ones
closest to 1 in relative entropy are exponential tilts: r = min(most,
exp(tilt * size / mean size)). The tilt of each source is the zero of the
convex dual's gradient, found by Newton steps kept within a bracket. All
documents of one source and size have one rate, so the steps run over counts by
(source, size), distributed, for all sources at once; the driver sees one
number a step.

Rates become whole copies by carrying the rounding error, in words, from larger
to smaller sizes within bounded groups of counts, so a source's taken words
miss its target by about the size of its smallest documents. Inside a count, a
hash of doc_id and text says which documents get the extra copy: those up to an
edge that is found exactly. The cells of (source, size) and their edges are as
many as there are sources times distinct sizes; they are broadcast if counted to
be few, and rows decide in place, so texts aren't shuffled. Reruns agree.

Defined results: null text counts as empty (size 0, taken 0); a null source is
a source; repeated rows are separate documents; an empty table gives no rows;
other columns are ignored, whatever their names (``mixed_documents`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

WEIGHTS = (1, 2, 3)
#: Rows of cells that may be broadcast, some 60 bytes each.
BROADCAST_ROWS = 500_000


def document_size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _key(source: Column) -> Column:
    """A non-null stand-in for a source that keeps null apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def source_ranks(sources: DataFrame) -> DataFrame:
    """(key, total, place from 0) by code point with null last, without one task that sees all sources."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key") == "n", F.col("key")]
    dealt = sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1), "mix-sources")
    before, at = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row a partition
        before.append((r["part"], at))
        at += r["count"]
    offsets = spark.createDataFrame(before, "part int, before long")
    return dealt.join(F.broadcast(offsets), "part").select("key", "total", (F.col("place") + F.col("before")).alias("place"))


def source_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """(key, total, target): shares by weight, cut at ``most`` times the total, the excess shared again until none is above."""
    index = (F.col("place") % len(WEIGHTS)).cast("int")
    rows = source_ranks(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), index + 1))
    rows = stored(rows, "mix-ranks")
    level, held = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > most * F.col("total")
        r = rows.agg(F.sum("total").alias("all"), F.sum(F.when(full, most * F.col("total")).otherwise(0.0)).alias("cut"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(full).alias("n")).first()
        if r["all"] is None or not r["free"] or r["n"] == held:
            break
        level, held = (r["all"] - r["cut"]) / r["free"], r["n"]
    share = F.lit(0.0) if level is None else F.col("weight") * level
    return rows.select("key", "total", F.least(share, most * F.col("total")).alias("target"))


def tilts(cells: DataFrame, targets: DataFrame, most: float = 3.0, steps: int = 100, within: float = 1e-9) -> DataFrame:
    """(key, mean, tilt) per source, by bracketed Newton steps on the dual."""
    stats = cells.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    top = math.log(most)
    state = targets.join(stats, "key").select(
        "key",
        "target",
        "mean",
        F.when((F.col("target") >= most * F.col("total") * (1 - 1e-12)) | (F.col("total") == 0), top * F.col("mean") / F.coalesce("least", F.lit(1))).otherwise(0.0).alias("tilt"),
        F.when(F.col("target") < F.col("total"), float("-inf")).otherwise(0.0).alias("low"),
        F.when(F.col("target") < F.col("total"), 0.0).otherwise(top * F.col("mean") / F.coalesce("least", F.lit(1))).alias("high"),
    )
    state = stored(state, "mix-tilts")
    for step in range(steps):
        x = F.col("size") / F.greatest("mean", F.lit(1e-9))
        power = F.col("tilt") * x
        rate = F.exp(F.least(power, F.lit(top)))
        words = F.col("n") * F.col("size") * rate
        sums = cells.join(state, "key").groupBy("key").agg(F.sum(words).alias("got"), F.sum(F.when(power < top, words * x).otherwise(0.0)).alias("slope"))
        miss = F.col("got") - F.col("target")
        low = F.when(miss <= 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        inside = F.coalesce((F.col("slope") > 0) & (newton > low) & (newton < high), F.lit(False))
        close = F.abs(miss) <= within * F.greatest("target", F.lit(1.0))
        new = F.when(close, F.col("tilt")).when(inside, newton).when(low == float("-inf"), F.least(2 * high, high - 1.0)).otherwise((low + high) / 2)
        joined = state.join(sums, "key")
        state = stored(joined.select("key", "target", "mean", new.alias("tilt"), low.alias("low"), high.alias("high"), (~close).alias("open")), f"mix-tilts-{step}")
        if not state.where("open").limit(1).count():
            return state.select("key", "mean", "tilt")
        state = state.drop("open")
    raise ArithmeticError(f"tilts don't meet their targets after {steps} steps")


def decisions(sizes: DataFrame, most: float = 3.0, group_cells: int = 20_000) -> DataFrame:
    """(key, size, total, target, each, edge, allowed, tied) per cell of rows (key, size, mark): every row of
    the cell is taken ``each`` times, once more if its mark is below ``edge``, and once more as well
    for ``allowed`` of the ``tied`` rows whose mark is the edge. ``sizes`` must be a stored table."""
    by_size = stored(sizes.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = stored(source_targets(by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total")), most), "mix-targets")
    rates = targets.join(tilts(by_size, targets, most), "key")
    groups = max(1, math.ceil(by_size.count() / group_cells))
    whole = int(most)

    def rounded(pdf):
        pdf = pdf.sort_values(["size"], ascending=[False])
        out, carry = [], 0.0
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            want = n * rate * size + carry
            k = min(whole * n, max(0, math.floor(want / size + 0.5))) if size else n
            carry = want - k * size
            out.append(k)
        return pdf[["key", "size", "n"]].assign(total_copies=out)

    power = F.least(F.col("tilt") * F.col("size") / F.greatest("mean", F.lit(1e-9)), F.lit(math.log(most)))
    given = (
        by_size.join(rates.select("key", "mean", "tilt"), "key")
        .withColumn("rate", F.exp(power))
        .withColumn("part", F.pmod(F.xxhash64("size"), F.lit(groups)))
        .select("key", "part", "size", "n", "rate")
        .groupBy("key", "part")
        .applyInPandas(rounded, "key string, size long, n long, total_copies long")
    )
    each = F.floor(F.col("total_copies") / F.col("n"))
    given = stored(given.select("key", "size", "n", each.alias("each"), (F.col("total_copies") - each * F.col("n")).alias("more")), "mix-copies")
    # the edge is the more-th smallest mark of a cell: found among its 4096 ranges of marks, then within one of them
    partial = sizes.join(_if_small(given.where("more > 0").select("key", "size", "more")), ["key", "size"]).withColumn("range", F.shiftright("mark", 52))
    ranges = partial.groupBy("key", "size", "more", "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("key", "size").orderBy("range"))
    ranges = stored(ranges.withColumn("upto", upto).where("upto >= more and upto - n < more"), "mix-ranges")
    inside = partial.select("key", "size", "mark", "range").join(_if_small(ranges.select("key", "size", "range", (F.col("more") - F.col("upto") + F.col("n")).alias("want"))), ["key", "size", "range"])
    marks = inside.groupBy("key", "size", "want", "mark").agg(F.count("*").alias("tied"))
    seen = F.sum("tied").over(W.partitionBy("key", "size").orderBy("mark"))
    edges = marks.withColumn("seen", seen).where("seen >= want and seen - tied < want").select("key", "size", F.col("mark").alias("edge"), (F.col("want") - F.col("seen") + F.col("tied")).alias("allowed"), "tied")
    return stored(given.join(edges, ["key", "size"], "left").join(targets, "key").select("key", "size", "total", "target", "each", "edge", "allowed", "tied"), "mix-decisions")


def _if_small(df: DataFrame) -> DataFrame:
    """Broadcast only if counted to be small; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _taken(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (with _mix_key, _mix_size, _mix_mark) and the ``_mix_copies`` of each, decided in place by the cells' edges.

    Only rows that share their mark with others, of which some are taken, are numbered in a window.
    """
    own = cells.select(*[F.col(c).alias(f"_mix_{c}") for c in cells.columns])
    joined = rows.withColumnsRenamed({"_mix_key": "_mix_k", "_mix_size": "_mix_s"}).join(_if_small(own), (F.col("_mix_k") == F.col("_mix_key")) & (F.col("_mix_s") == F.col("_mix_size"))).drop("_mix_k", "_mix_s")
    some = F.coalesce((F.col("_mix_mark") == F.col("_mix_edge")) & (F.col("_mix_allowed") < F.col("_mix_tied")), F.lit(False))
    below = F.coalesce((F.col("_mix_mark") <= F.col("_mix_edge")).cast("long"), F.lit(0))
    plain = joined.where(~some).withColumn("_mix_copies", F.col("_mix_each") + below)
    if not cells.where("allowed < tied").limit(1).count():
        return plain
    turn = F.row_number().over(W.partitionBy("_mix_key", "_mix_size", "_mix_mark").orderBy(F.lit(0)))
    return plain.unionByName(joined.where(some).withColumn("_mix_copies", F.col("_mix_each") + (turn <= F.col("_mix_allowed")).cast("long")))


def _measured(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` and what the mix knows of a row: source, size, and a mark that only rows of the same doc_id and text share."""
    return docs.withColumns({"_mix_key": _key(F.col(source)), "_mix_size": document_size(text_or_empty()), "_mix_mark": F.xxhash64("doc_id", "text")})


def _sizes(docs: DataFrame, source: str) -> DataFrame:
    rows = _measured(docs.select("doc_id", "text", source) if source not in ("doc_id", "text") else docs.select("doc_id", "text"), source)
    return stored(rows.select("doc_id", *[F.col(f"_mix_{c}").alias(c) for c in ("key", "size", "mark")]), "mix-documents")


def mix_report(docs: DataFrame, source: str = "source", most: float = 3.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    sizes = _sizes(docs, source)
    rows = _taken(sizes.toDF("doc_id", "_mix_key", "_mix_size", "_mix_mark"), decisions(sizes, most))
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"), F.col("_mix_copies").alias("copies"))


def mixed_documents(docs: DataFrame, source: str = "source", most: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Texts are read twice rather than shuffled: each row finds its copies by its cell.
    """
    cells = decisions(_sizes(docs, source), most)
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    fixed = {"doc_id", "text", source}
    renamed = docs.withColumnsRenamed({c: n for c, n in zip(docs.columns, names, strict=True) if c not in fixed})
    rows = _taken(_measured(renamed, source), cells).where("_mix_copies > 0")
    again = rows.withColumn("_mix_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return again.select(*[F.col(c if c in fixed else n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
