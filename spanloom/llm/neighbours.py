"""Approximate nearest neighbours by cosine, with an adaptive dimension scan.

Equal vectors are one class, kept with its smallest ids, so a common vector is
searched once and costs one candidate. Unit vectors are rotated by a fixed
random rotation and dealt to lists by their nearest centroid; the centroids are
fitted on at most ``SAMPLE`` vectors (by hash), every vector is indexed. Lists
are split into slots of about ``SLOT`` vectors, so a large one is many tasks.

A query scans the slots of its nearest lists, ``probes`` at least. Where there
are more lists, at most ``TRIALS`` queries are compared with the whole index, and
the lists probed are as many as held ``RECALL`` of their true neighbours, all if
need be. Vectors lie in blocks of columns, and distances grow block by block;
after each a candidate whose partial distance, scaled to all columns, exceeds the
query's bound by more than a chance deviation of a random rotation allows
(1 + EPSILON / sqrt(columns seen)) is abandoned. A query's first bound comes from
the first rows of its ``FIRST`` nearest lists; the k-th distance found in these
goes with the query to the other lists, and everywhere each step of rows tightens
it for the next. All queries of a list are scanned together, at most ``ASKING`` of
them in a task. Scores of those left are computed in double precision on the
original vectors.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do those of another length than the most common
one; rows with a null vec_id take no part; repeated rows are separate
candidates; a query never finds its own vec_id; fewer candidates than ``k`` are
all returned if the probed lists hold them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SAMPLE, LIST_ROWS, MOST_LISTS, SLOT = 20_000, 128, 4096, 4096
PROBES, BLOCK, EPSILON = 24, 8, 1.3
FIRST, ASKING, PAIRS = 4, 1024, 400_000
#: Queries that recall is measured on, and the share of their neighbours that probed lists must hold; abandoning takes up to 0.03.
TRIALS, RECALL = 256, 0.98


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that can take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(class_id, v, ids): equal vectors once, with their k + 1 smallest ids (a repeated id counts each time)."""
    coded = rows.withColumn("code", F.xxhash64("v"))
    # smallest ids first within slots of ids, then over the slots: a common vector is no single task
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    some = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    parts = coded.groupBy("code", "v", slot.alias("slot")).agg(some.alias("ids"))
    return parts.groupBy("code", "v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).select(F.element_at("ids", 1).alias("class_id"), "v", "ids")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows by a power of two so that squares neither overflow nor vanish; exact, and no cosine changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def rotation(n: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def fit_centroids(classes: DataFrame, n_lists: int, turned: np.ndarray, steps: int = 12) -> np.ndarray:
    """Spherical k-means over a sample of at most SAMPLE rotated unit vectors, the smallest by a hash of their ids."""
    rows = classes.select("class_id", "v").orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).collect()
    x = _unit(np.array([r["v"] for r in rows])) @ turned
    c = x[np.random.default_rng(2).permutation(len(x))[:n_lists]]
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
    return c


def column_blocks(x: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """``x`` as contiguous blocks of columns."""
    return [np.ascontiguousarray(x[:, lo : lo + block]) for lo in range(0, x.shape[1], block)]


def adaptive_scan(queries: np.ndarray, blocks: list[np.ndarray], k: int, bounds: np.ndarray | None = None, epsilon: float = EPSILON, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, squared distance) of rows of ``blocks`` that may be among the k nearest to each of ``queries`` (all
    rotated), nearest first, and how many numbers of the rows were read.

    Rows come ``step`` at a time (32 first, where a query has no bound yet) and are held against each query's bound: the
    squared distance given in ``bounds``, or the k-th of the steps before if that is less.
    """
    n, dims = len(blocks[0]), queries.shape[1]
    parts = np.split(queries, np.cumsum([b.shape[1] for b in blocks])[:-1], axis=1)
    bound = np.full(len(queries), np.inf) if bounds is None else np.array(bounds, "f8")
    which, rows_, near = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    read, first = 0, 0
    while first < n:
        rows = np.arange(first, min(first + (step if first or np.isfinite(bound).all() else 32), n))
        found = [(which, rows_, near)]
        for lo in range(0, len(queries), max(1, PAIRS // len(rows))):
            some = np.arange(lo, min(lo + max(1, PAIRS // len(rows)), len(queries)))
            qi, ri = np.repeat(some, len(rows)), np.tile(rows, len(some))
            partial, seen, limit = np.zeros(len(qi)), 0, bound[qi] * (1 + 1e-9)
            for b, q in zip(blocks, parts, strict=True):
                away = b[ri] - q[qi]
                partial += np.einsum("ij,ij->i", away, away)
                seen += b.shape[1]
                read += away.size
                keep = partial <= limit * ((1 + epsilon / math.sqrt(seen)) ** 2 * seen / dims if seen < dims else 1)
                qi, ri, partial, limit = qi[keep], ri[keep], partial[keep], limit[keep]
            found.append((qi, ri, partial))
        which, rows_, near = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rows_, near, which))
        which, rows_, near = which[order], rows_[order], near[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        last = place == k - 1
        bound[which[last]] = np.minimum(bound[which[last]], near[last])
        keep = place < k
        which, rows_, near = which[keep], rows_[keep], near[keep]
        first = int(rows[-1]) + 1
    return which, rows_, near, read


def needed_probes(index: DataFrame, searched: DataFrame, k: int, model) -> int:
    """Lists to probe so that RECALL of the k nearest classes of at most TRIALS queries lie in them, by comparing with all of ``index``."""
    trials = searched.select("class_id", "v").orderBy(F.xxhash64("class_id"), "class_id").limit(TRIALS).collect()
    turned, c = model.value
    q = _unit(np.array([r["v"] for r in trials])) @ turned
    names = np.array([r["class_id"] for r in trials])
    asked = searched.sparkSession.sparkContext.broadcast((q, names))

    def compare(batches):
        import pyarrow as pa

        q_, names_ = asked.value
        score, lists = np.zeros((len(q_), 0)), np.zeros((len(q_), 0), "i4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                near = q_ @ (_unit(_matrix(part.column(1))) @ model.value[0]).T
                near[names_[:, None] == part.column(0).to_numpy(zero_copy_only=False)] = -np.inf
                score = np.concatenate([score, near], axis=1)
                lists = np.concatenate([lists, np.broadcast_to(part.column(2).to_numpy(), near.shape)], axis=1)
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, lists = np.take_along_axis(score, best, 1), np.take_along_axis(lists, best, 1)
        query = np.repeat(np.arange(len(q_)), score.shape[1])
        yield pa.record_batch([pa.array(query.astype("i4")), pa.array(lists.ravel().astype("i4")), pa.array(score.ravel())], names=["query", "list", "score"])

    hits = index.select("class_id", "v", "list").mapInArrow(compare, "query int, list int, score double").where(F.col("score") > float("-inf"))
    hits = hits.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "list"))).where(F.col("place") <= k)
    order = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    places = np.sort([order[r["query"], r["list"]] for r in hits.select("query", "list").collect()])
    return int(places[math.ceil(RECALL * len(places)) - 1]) + 1 if len(places) else 1


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score, probes, columns_read): the k nearest found for each row that ``is_query`` (of vec_id)
    holds for; the lists probed by each query and the share of the probed vectors' columns that was read stand in every row."""
    valid = stored(valid_vectors(df, key, vector), "ann-vectors")
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probes int, columns_read double")
    classes = stored(vector_classes(valid, k), "ann-classes")
    n = classes.count()
    if not n:
        return empty
    n_lists = max(1, min(MOST_LISTS, math.ceil(n / LIST_ROWS)))
    turned = rotation(len(classes.select("v").first()["v"]))
    centroids = fit_centroids(classes, n_lists, turned)
    n_lists, probes = len(centroids), min(probes, len(centroids))
    model = spark.sparkContext.broadcast((turned, centroids))  # at most MOST_LISTS rows

    def deal(batches, probes_: int):
        import pyarrow as pa

        turned_, c = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                if not part.num_rows:
                    continue
                near = -(_unit(_matrix(part.column(1))) @ turned_ @ c.T)
                lists = np.argpartition(near, probes_ - 1, axis=1)[:, :probes_] if probes_ < n_lists else np.tile(np.arange(n_lists), (part.num_rows, 1))
                lists = np.take_along_axis(lists, np.argsort(np.take_along_axis(near, lists, 1), axis=1, kind="stable"), 1)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(list(lists.astype("i4")), pa.list_(pa.int32()))], names=["class_id", "v", "lists"])

    def dealt(rows: DataFrame, p: int) -> DataFrame:
        return rows.select("class_id", "v").mapInArrow(lambda b: deal(b, p), f"class_id {id_type}, v array<double>, lists array<int>")

    id_type = dict(classes.dtypes)["class_id"]
    index = dealt(classes, 1).select("class_id", "v", F.col("lists")[0].alias("list"))
    index = stored(index, "ann-index")
    slots = index.groupBy("list").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    wanted = valid.where(is_query).select("vec_id", "v")
    # a query's class is found by its vector; each class is searched once
    asked = wanted.withColumn("code", F.xxhash64("v")).join(classes.select("class_id", F.col("v").alias("_v"), F.xxhash64("v").alias("code")), "code").where(F.col("v") == F.col("_v"))
    asked = stored(asked.select("vec_id", "class_id"), "ann-queries")
    searched = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi")
    if probes < n_lists:
        probes = max(probes, needed_probes(index, searched, k, model))
    probe = dealt(searched, probes).select("class_id", "v", F.posexplode("lists").alias("nth", "list"))

    def scan(left, right):
        import pandas as pd

        if not (len(left) and len(right)):
            return pd.DataFrame({"query": [], "class_id": [], "score": [], "away": [], "read": [], "held": []})
        turned_, _ = model.value
        q, x = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        order = np.argsort(right["class_id"].to_numpy(), kind="stable")
        x, names = x[order], right["class_id"].to_numpy()[order]
        qi, ri, away, read = adaptive_scan(_unit(q) @ turned_, column_blocks(_unit(x) @ turned_), min(k + 1, len(x)), left["bound"].to_numpy())
        x, q = _scaled(x), _scaled(q)
        score = (x[ri] * q[qi]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1))[ri] * np.sqrt((q * q).sum(axis=1))[qi])
        none = [None]  # a row of its own for what was read
        return pd.DataFrame({"query": [*left["class_id"].to_numpy()[qi], *none], "class_id": [*names[ri], *none], "score": [*score, *none], "away": [*away, *none], "read": [0] * len(ri) + [read], "held": [0] * len(ri) + [len(x) * q.size]})

    def scanned(asking: DataFrame) -> DataFrame:
        """Hits of queries (class_id, v, list, bound); lists are dealt to slots on both sides."""
        asking = stored(asking, "ann-asking")
        parts = asking.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts"))
        deals = slots.join(parts, "list")  # a row a list
        left = asking.join(F.broadcast(deals), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.pmod(F.xxhash64("class_id", "list"), F.col("parts")).cast("int").alias("part"), "class_id", "v", "bound")
        right = index.join(F.broadcast(deals), "list").select("list", F.pmod(F.xxhash64("class_id"), F.col("slots")).cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class_id", "v")
        key = ("list", "slot", "part")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, f"query {id_type}, class_id {id_type}, score double, away double, read long, held long")

    def top_hits(hits: DataFrame) -> DataFrame:
        ranked = hits.where("score is not null").withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class_id")))
        return ranked.where(F.col("place") <= k + 1)

    nearest_lists = F.col("nth") < FIRST
    hits = stored(scanned(probe.where(nearest_lists).select("class_id", "v", "list", F.lit(float("inf")).alias("bound"))), "ann-hits")
    if probes > FIRST:
        full = top_hits(hits).groupBy("query").agg(F.max("away").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k + 1)
        rest = probe.where(~nearest_lists).join(full.select(F.col("query").alias("class_id"), "bound"), "class_id", "left")
        hits = hits.union(stored(scanned(rest.select("class_id", "v", "list", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))), "ann-hits"))
    used = hits.where("score is null").agg(F.sum("read"), F.sum("held")).first()
    share = (used[0] or 0) / used[1] if used[1] else 0.0
    best = top_hits(hits)
    best = stored(best.join(classes.select("class_id", "ids"), "class_id").select("query", "score", "ids"), "ann-best")
    listed = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    listed = listed.select(F.col("query").alias("class_id"), F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("minus"), i.alias("vec_id"))))).alias("found"))
    rows = asked.join(listed, "class_id")
    top = F.slice(F.sort_array(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id"))), 1, k)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(top).alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.minus")).alias("score"), F.lit(probes).alias("probes"), F.lit(share).alias("columns_read"))
