"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

1. Document frequencies of all 5-word shingles are counted over all documents in
   a table of 2**20 hashed counters, summed over tasks. A counter holds its
   shingle's frequency and the average load, so idf resolves frequencies down to
   (shingles a document / 2**20) of the corpus, at any corpus size.
2. A shingle's weight is (1 + ln times) * idf, with idf from 1 (in every text) to
   1.25 (in few). It is damped on purpose: with a plain logarithm the edits of a
   copy weigh many times what it shares with a large group of copies, and such
   groups would fall apart.
3. Improved consistent weighted sampling draws 30 samples (shingle, level) a text,
   equal for two texts with probability their weighted Jaccard similarity; bands
   of 3 make 10 keys. Equal texts are one node.
4. In each bucket of equal keys, all nodes are first compared with one leader,
   the node that shares most buckets with others, then with the first node that
   has no link yet, by exact weighted Jaccard similarity of whole texts. Then all
   other pairs of a bucket whose ends aren't in one component are compared, block
   by block: by weight sums and by a bound from sums of weights in 128 cells,
   neither of which loses a pair, then by their whole texts, best bounds first,
   until each pair left has both ends in one component. Only those pairs are not
   compared. A bucket of n nodes without links costs n * n / 2 bounds.
5. Classes are the connected components of the links, by hooking and pointer
   jumping over stored tables; a class is named by its smallest doc_id.

Defined results: null text counts as empty; texts without words are classed by
equality alone; repeated rows are in one class; a null doc_id names a class
only if no other does; an empty table gives no rows; other columns are ignored
(``deduplicated`` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import released, stored, text_or_empty
from .shingles import U, chunks, mix, shingles

TABLE_BITS, PART_BITS = 20, 12
BANDS, ROWS = 10, 3
IDF_RANGE = 0.25
#: Cells of a text's sketch, nodes of a block, rounds of leaders, and pairs of two components verified in the first round.
CELLS, BLOCK, LEADERS, FIRST_PAIRS = 128, 512, 2, 4
#: Rows of two keys that may be broadcast, some 40 bytes each.
BROADCAST_ROWS = 500_000


def _node():
    """Identity of a text: equal texts are one node."""
    return F.unhex(F.md5(text_or_empty()))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of all shingles and the number of documents; 4 MB at any corpus size."""

    def count(batches):
        import pyarrow as pa

        total, rows = np.zeros(1 << TABLE_BITS, "i8"), 0
        for batch in batches:
            rows += batch.num_rows
            for _, part in chunks(batch.column(0)):
                _, s, _ = shingles(part)
                total += np.bincount((s >> U(48 - TABLE_BITS)).astype("i8"), minlength=len(total))
        if rows:
            cut = total.astype("<u4").reshape(-1, 1 << PART_BITS)
            yield pa.record_batch([pa.array([*range(len(cut)), -1], pa.int32()), pa.array([*(c.tobytes() for c in cut), rows.to_bytes(8, "little")], pa.binary())], names=["part", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(counts, "<u4" if part >= 0 else "<i8").astype("i8")
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    texts = docs.select(text_or_empty().alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(released(count), schema).repartition(parts, "part").mapInArrow(released(add), schema).collect()
    found = {r["part"]: np.frombuffer(bytes(r["counts"]), "<i8") for r in rows}
    if not found:
        return np.zeros(1 << TABLE_BITS, "i8"), 0
    return np.concatenate([found[k] for k in range(1 << (TABLE_BITS - PART_BITS))]), int(found[-1][0])


def idf_table(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    share = np.clip(np.maximum(frequencies, 1) / max(n_docs, 1), 1 / max(n_docs, 2), 1)
    return (1 + IDF_RANGE * -np.log(share) / math.log(max(n_docs, 2))).astype("f4")


def weights(s: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(times)) * idf[(s >> U(48 - TABLE_BITS)).astype("i8")]).astype("f4")


def _gamma_table(size: int = 4096) -> np.ndarray:
    """Quantiles of the gamma(2, 1) distribution at equal steps."""
    p, x = (np.arange(size) + 0.5) / size, np.full(size, 1.5)
    for _ in range(100):
        x = np.maximum(x - np.clip((1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), -0.5, 0.5), 1e-6)
    return x.astype("f4")


def samples(row: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(rows with shingles, n) sample hashes. Row r's draw j is the same for all rows that weigh its shingle alike."""
    gamma = _gamma_table()
    over, log_gamma = 1 / gamma, np.log(gamma)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    log_w, place = np.log(w), np.arange(len(s), dtype=U)
    out = np.empty((len(starts), n), U)
    for j in range(n):
        z = s * U(0xA24BAED4963EE407 + 2 * j * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF | 1)
        z ^= z >> U(29)
        z *= U(0xBF58476D1CE4E5B9)
        i, k = (z >> U(52)).astype("i4"), ((z >> U(40)) & U(4095)).astype("i4")
        beta = ((z >> U(16)) & U(0xFFFFFF)).astype("f4") * np.float32(2.0**-24)
        r = gamma[i]
        t = np.floor(log_w * over[i] + beta)
        a = log_gamma[k] - r * (t - beta + 1)
        best = np.minimum.reduceat((((a + np.float32(256)) * np.float32(1 << 20)).astype(U) << U(32)) | place, starts)
        at = (best & U(0xFFFFFFFF)).astype("i8")
        out[:, j] = mix(s[at] * U(0x9E3779B97F4A7C15) + t[at].astype("i8").astype(U))
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, node, bands): the band keys of each document's text; null without words."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2)
            for lo, part in chunks(texts):
                row, s, times = shingles(part)
                size = np.zeros(len(part), "i4")
                keys = np.zeros(0, "i8")
                if len(s):
                    drawn = samples(row, s, weights(s, times, table.value), BANDS * ROWS).reshape(-1, BANDS, ROWS)
                    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), drawn.shape[:2])
                    for k in range(ROWS):
                        acc = mix(acc * U(0xD6E8FEB86659FD93) + drawn[:, :, k])
                    keys = acc.astype("i8").ravel()
                    size[np.unique(row)] = BANDS
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), batch.column(1).slice(lo, len(part)), bands], names=["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), _node().alias("node"), text_or_empty().alias("text")).mapInArrow(released(sign), "doc_id long, node binary, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum(dtype="f8")
    return float(least / (a[1].sum(dtype="f8") + b[1].sum(dtype="f8") - least))


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Pairs (leader, node) with ok: their whole texts' weighted Jaccard similarity suffices."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                both = pa.concat_arrays([part.column(2), part.column(3)])
                n, sets = part.num_rows, {}
                for first, texts_ in chunks(both):
                    row, s, times = shingles(texts_)
                    w = weights(s, times, table.value)
                    cut = np.searchsorted(row, np.arange(len(texts_) + 1))
                    for i in range(len(texts_)):
                        sets[first + i] = s[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
                ok = [weighted_jaccard(sets[i], sets[n + i]) >= similarity for i in range(n)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["leader", "node", "ok"])

    left, right = texts.select(F.col("node").alias("leader"), F.col("text").alias("a")), texts.select("node", F.col("text").alias("b"))
    return pairs.join(left, "leader").join(right, "node").select("leader", "node", "a", "b").mapInArrow(released(verify), "leader binary, node binary, ok boolean")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast only if counted to be small; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sketches(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, total, scale, cells): the weight sum of a text, and those of its CELLS cells of shingles as bytes times scale, rounded up."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, part in chunks(batch.column(1)):
                row, s, times = shingles(part)
                n = len(part)
                sums = np.bincount(row * CELLS + (s % U(CELLS)).astype("i8"), weights(s, times, table.value), n * CELLS).reshape(n, CELLS)
                scale = np.maximum(sums.max(axis=1), 1e-9) / 255
                cells = np.minimum(np.ceil(sums / scale[:, None]), 255).astype("u1")
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(sums.sum(axis=1)), pa.array(scale), pa.array([c.tobytes() for c in cells], pa.binary())], names=["node", "total", "scale", "cells"])

    return texts.select("node", "text").mapInArrow(released(sketch), "node binary, total double, scale double, cells binary")


def _bounded(block, similarity: float):
    """Pairs of one block of a bucket, or of two, that may be similar: other components, no earlier band shared, bound large enough."""
    import pyarrow as pa

    def column(name: str) -> np.ndarray:
        return block.column(name).to_numpy()

    least = similarity - 1e-4  # more than rounding takes
    order = np.argsort(column("total"), kind="stable")
    total, side, band = column("total")[order], column("side")[order], int(block.column("band")[0].as_py())
    root = block.column("root").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    bands = np.array(block.column("bands").to_pylist(), "i8")[order]
    cells = np.frombuffer(b"".join(block.column("cells").to_pylist()), "u1").reshape(-1, CELLS)[order] * column("scale")[order].astype("f4")[:, None]
    across = block.column("i")[0].as_py() != block.column("j")[0].as_py()
    ends = np.searchsorted(total, total / least, "right")
    left, right, bounds = [], [], []
    for a in range(len(total)):
        other = a + 1 + np.flatnonzero(root[a + 1 : ends[a]] != root[a])
        if across:
            other = other[side[other] != side[a]]
        if band:
            other = other[~(bands[other, :band] == bands[a, :band]).any(axis=1)]
        if not len(other):
            continue
        both = np.minimum(cells[other], cells[a]).sum(axis=1)
        bound = both / np.maximum(total[a] + total[other] - both, 1e-9)
        fine = bound >= least
        left.append(np.full(int(fine.sum()), a))
        right.append(other[fine])
        bounds.append(bound[fine])
    names = block.column("node").to_pylist()
    left, right, bounds = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (left, right, bounds))
    pairs = [sorted((names[order[x]], names[order[y]])) for x, y in zip(left, right, strict=True)]
    return pa.table([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary()), pa.array(bounds.astype("f8"))], names=["leader", "node", "bound"])


def _rooted(df: DataFrame, roots: DataFrame | None, node: str, root: str) -> DataFrame:
    """``df`` with the component of its column ``node``; a node without links is its own."""
    if roots is None:
        return df.withColumn(root, F.col(node))
    return df.join(roots.toDF(node, "_root"), node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def _candidates(shared: DataFrame, roots: DataFrame | None, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """(leader, node, bound): all pairs of a bucket in two components that may be similar, each pair once."""
    members = stored(_rooted(shared.where("n > 2").select("key", "node", "bands", "band", "n"), roots, "node", "root"), "near-rooted")
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    members = stored(members.join(apart, "key"), "near-apart")
    asked = members.select("node").distinct()
    sketches = stored(_sketches(texts.join(asked, "node", "left_semi"), idf), "near-sketches")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sketches, "node")
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "band", "node", "root", "bands", "total", "scale", "cells")
    return members.groupBy("key", "i", "j").applyInArrow(lambda block: _bounded(block, similarity), "leader binary, node binary, bound double")


def links(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, similarity: float = 0.8) -> DataFrame | None:
    """Links (leader, node) between nodes (node, first_id, bands); None if there are none.

    ``open`` marks members that have no link yet. The texts of all members of
    shared buckets are fetched once.
    """
    members = nodes.select("node", "bands", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "key"), "near-members")
    scores = stored(shared.groupBy("node").agg(F.sum("n").alias("score")), "near-scores")
    wanted = _maybe_broadcast(scores.select("node").join(nodes.select("node", "first_id"), "node")).withColumnRenamed("node", "_wanted")
    texts = docs.select("doc_id", _node().alias("node"), text_or_empty().alias("text"))
    texts = texts.join(wanted, (F.col("node") == F.col("_wanted")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])
    texts = stored(texts, "near-texts")
    members = shared.drop("n").join(scores, "node").withColumn("open", F.lit(True))
    tried = None
    for step in range(LEADERS):
        buckets = members.groupBy("key").agg(F.max(F.when(F.col("open"), F.struct("score", "node"))).alias("top"), F.count("*").alias("n"))
        buckets = buckets.where("n > 1 and top is not null").select("key", F.col("top.node").alias("leader"))
        near = stored(members.join(buckets, "key").where("node != leader"), f"near-buckets-{step}")
        if near.limit(1).count() == 0:
            break
        pairs = near.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["leader", "node"], "left_anti")
        tested = stored(_verified(pairs, texts, idf, similarity), f"near-tested-{step}")
        tried = tested if tried is None else tried.unionByName(tested)
        linked = tried.where("ok").select(F.explode(F.array("leader", "node")).alias("node")).distinct().withColumn("linked", F.lit(True))
        members = near.join(linked, "node", "left").select("node", "bands", "band", "key", "score", (F.col("open") & F.col("linked").isNull()).alias("open"))
    if tried is None:
        return None
    edges = stored(tried.where("ok").drop("ok"), "near-links")
    roots = components(edges)
    left = stored(_candidates(shared, roots, texts, idf, similarity).join(tried, ["leader", "node"], "left_anti"), "near-candidates")
    most, step = FIRST_PAIRS, 0
    while True:
        apart = _rooted(_rooted(left, roots, "leader", "ra"), roots, "node", "rb").where("ra != rb")
        place = F.row_number().over(W.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.desc("bound"), "leader", "node"))
        apart = stored(apart.select("leader", "node", "bound", place.alias("place")), f"near-left-{step}")
        if apart.limit(1).count() == 0:
            return edges
        now = apart.where(F.col("place") <= most).select("leader", "node")
        found = stored(_verified(now, texts, idf, similarity).where("ok").drop("ok"), f"near-found-{step}")
        left = apart.where(F.col("place") > most).select("leader", "node", "bound")
        if found.limit(1).count():
            edges = edges.unionByName(found)
            roots = components(edges)
        most, step = most * 16, step + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (leader, node): hooking to smaller roots and pointer jumping, stored each round."""
    both = edges.union(edges.select("node", "leader")).toDF("node", "other")
    parent = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "near-roots")
    step = 0
    while True:
        a, b = parent.toDF("leader", "ra"), parent.toDF("node", "rb")
        apart = edges.join(a, "leader").join(b, "node").where("ra != rb")
        hooks = stored(apart.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("lower")), f"near-hooks-{step}")
        if hooks.limit(1).count() == 0:
            jumped = parent.join(parent.toDF("root", "up"), "root").select("node", "root", "up")
            if jumped.where("root != up").limit(1).count() == 0:
                return parent
        hooked = stored(parent.join(hooks, "root", "left").select("node", F.coalesce("lower", "root").alias("root")), f"near-hooked-{step}")
        parent = stored(hooked.join(hooked.toDF("root", "up"), "root").select("node", F.col("up").alias("root")), f"near-roots-{step}")
        step += 1


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, node, bands; nodes node, first_id, class_id, kept)."""
    frequencies, n_docs = document_frequencies(docs)
    idf = idf_table(frequencies, n_docs)
    rows = stored(signatures(docs, idf), "near-signatures")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "near-nodes")
    edges = links(docs, nodes, idf, similarity)
    named = nodes.select("node", "first_id")
    if edges is None:
        return rows, named.withColumns({"class_id": F.col("first_id"), "kept": F.lit(True)})
    roots = components(edges)
    rooted = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")).alias("m"))
    joined = rooted.join(best, "root")
    return rows, stored(joined.select("node", "first_id", F.col("m.first_id").alias("class_id"), (F.col("node") == F.col("m.node")).alias("kept")), "near-classes")


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its class)."""
    rows, nodes = _classes(docs, similarity)
    return rows.select("doc_id", "node").join(nodes.select("node", "class_id"), "node").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all their columns kept.

    Only what must go or is repeated is joined to the documents.
    """
    rows, nodes = _classes(docs, similarity)
    copies = rows.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    special = copies.join(nodes, "node").select(
        F.col("doc_id").alias("_near_id"), F.col("node").alias("_near_node"), (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("_near_kept"), F.col("n").alias("_near_n")
    )
    special = _maybe_broadcast(stored(special.where("not _near_kept or _near_n > 1"), "near-special"))
    # own columns stand beside those of ``docs`` under names that it hasn't
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    joined = docs.toDF(*names.values()).withColumnRenamed(names["text"], "text").withColumn("_near_own", _node()).withColumnRenamed("text", names["text"])
    joined = joined.join(special, F.col(names["doc_id"]).eqNullSafe(F.col("_near_id")) & (F.col("_near_own") == F.col("_near_node")), "left")
    single = joined.where("_near_kept is null")
    repeated = joined.where("_near_kept").dropDuplicates([names["doc_id"], "_near_own"])
    return single.unionByName(repeated).select(*[F.col(n).alias(c) for c, n in names.items()])
