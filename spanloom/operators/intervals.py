"""Generic interval operators: islands, overlap and containment joins, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.files import written


def islands(df: DataFrame, keys: list[str], start: str, end: str, joins: Column | None = None, within: float = 0.0, order: list[str] = (), strict: bool = False) -> DataFrame:
    """``df`` with ``island``, a number per key: rows whose start lies within ``within`` of the largest end so far
    are one island (with ``strict``: less than ``within``). ``joins``, if given, must hold as well."""
    ordered = W.partitionBy(*keys).orderBy(start, *order)
    far = F.max(end).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    near = F.col(start) < far + within if strict else F.col(start) <= far + within
    if joins is not None:
        near = near & joins
    fresh = F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(ordered.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def with_buckets(df: DataFrame, start: str, end: str, size: float, name: str = "_bucket") -> DataFrame:
    """A row for each bucket of ``size`` that [start, end] reaches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.greatest(F.col(end), F.col(start)) / size))))


def of_keys(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys ``others`` have. The distinct keys are written first, so Spark knows their size: where they are
    few, the other rows go before any shuffle."""
    return rows.join(written(others.select(*keys).distinct(), "keys"), keys, "left_semi")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, size: float) -> DataFrame:
    """Pairs with ls < re and le > rs on equal keys. Both sides are dealt to buckets; a pair is
    emitted only in the bucket where the later of its starts lies, so none repeats."""
    a, b = with_buckets(left, ls, le, size), with_buckets(right, rs, re, size)
    joined = a.join(b, [*keys, "_bucket"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / size) == F.col("_bucket")
    return joined.where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & first).drop("_bucket")


def containment_join(inner: DataFrame, outer: DataFrame, keys: list[str], ins: str, ine: str, outs: str, oute: str, size: float) -> DataFrame:
    """Pairs with the inner interval inside the outer one. Only the outer side is dealt to several buckets."""
    a = inner.withColumn("_bucket", F.floor(F.col(ins) / size))
    b = with_buckets(outer, outs, oute, size)
    return a.join(b, [*keys, "_bucket"]).where((F.col(ins) >= F.col(outs)) & (F.col(ine) <= F.col(oute))).drop("_bucket")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, forward: bool = False) -> DataFrame:
    """Each point with the last mark at or before it (``forward``: first at or after), one sort and no range join.

    ``marks`` has the keys, ``mark`` and other columns, which come back null where there is none.
    """
    others = [c for c in marks.columns if c not in keys]
    a = points.select(*keys, F.col(at).alias("_at"), F.lit(1 if not forward else 0).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(marks.select(F.struct(*others).alias("m")).schema["m"].dataType).alias("_m"))
    b = marks.select(*keys, F.col(mark).alias("_at"), F.lit(0 if not forward else 1).alias("_side"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), F.struct(*others).alias("_m"))
    # forward runs from the end, as a frame that grows costs one step a row and one that shrinks a whole pass
    order = [F.desc("_at"), F.desc("_side")] if forward else ["_at", "_side"]
    found = F.last("_m", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = a.unionByName(b).withColumn("_found", found).where("_p is not null")
    return joined.select("_p.*", *[F.col(f"_found.{c}").alias(c) for c in others])
