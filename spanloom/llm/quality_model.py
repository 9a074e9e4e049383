"""A quality classifier on random-indexing word vectors.

Each word has two units: its hash among 2**16 buckets, and the hash of its
shape (capitals, small letters, digits and signs, runs squeezed) among 2**10. A
unit's index vector has one +1 and one -1 among 32 places, given by its number;
its word vector is the sum of the index vectors of the units two words to
either side, over all documents. The vectors take 9 MB, however large the
corpus (``WORD_BITS`` sets it); tasks sum their own and Spark adds them up.

A document is the mean of its words' unit vectors and of its shapes', with the
lengths of the two means, ln(1 + words) and the share of distinct words. A
two-layer network (tanh, logistic) is fitted with numpy on at most ``SAMPLE``
labelled rows, the smallest by a hash of doc_id; a fifth of them sets the
temperature that calibrates the probabilities. Scoring runs in tasks.

Rows with crc32(doc_id as text) mod 4 = 2 are held out: their labels are never
read. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null text counts as empty and gets a score like any text; a
null doc_id isn't held out and has no label; several labels of one doc_id count
by their mean, null ones not; repeated rows of a doc_id are scored one by one
and are one example for the fit; an empty
table gives no rows; without labels every score is 0.5; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .shingles import chunks, mix, word_and_shape_hashes

WORD_BITS, SHAPE_BITS, DIMS = 16, 10, 32
UNITS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
FEATURES = 2 * DIMS + 4
SAMPLE = 20_000
KEPT_FROM = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _units(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, word, shape = word_and_shape_hashes(texts)
    return row, (word >> np.uint64(64 - WORD_BITS)).astype("i8"), (1 << WORD_BITS) + (shape >> np.uint64(64 - SHAPE_BITS)).astype("i8")


def _index_places() -> tuple[np.ndarray, np.ndarray]:
    """Places of the +1 and the -1 of each unit's index vector."""
    h = mix(np.arange(1, UNITS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    plus = (h % np.uint64(DIMS)).astype("i8")
    return plus, (plus + 1 + ((h >> np.uint64(20)) % np.uint64(DIMS - 1)).astype("i8")) % DIMS


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(UNITS, DIMS) vectors of unit length (zero for units never seen), from all documents."""

    def count(batches):
        import pyarrow as pa

        plus, minus = _index_places()
        total, seen = np.zeros(UNITS * DIMS, "i8"), False
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                row, word, shape = _units(part)
                seen |= bool(len(row))
                for gap in (1, 2):
                    same = row[gap:] == row[:-gap]
                    for unit in (word, shape):
                        left, right = unit[:-gap][same], unit[gap:][same]
                        for own, other in ((left, right), (right, left)):
                            total += np.bincount(own * DIMS + plus[other], minlength=len(total))
                            total -= np.bincount(own * DIMS + minus[other], minlength=len(total))
        if seen:
            cut = total.reshape(-1, 1 << SHAPE_BITS, DIMS)
            yield pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in cut], pa.binary())], names=["part", "sums"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(values, "<i8")
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).collect()
    total = np.zeros((UNITS >> SHAPE_BITS, (1 << SHAPE_BITS) * DIMS))
    for r in rows:
        total[r["part"]] = np.frombuffer(bytes(r["sums"]), "<i8")
    v = total.reshape(UNITS, DIMS)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype("f4")


def document_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features array<float>) of whole texts."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        import pyarrow as pa

        v = table.value
        for batch in batches:
            for lo, part in chunks(batch.column(1)):
                row, word, shape = _units(part)
                out = np.zeros((len(part), FEATURES), "f4")
                if len(row):
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    rows, n = row[starts], np.diff(np.append(starts, len(row)))
                    for k, unit in enumerate((word, shape)):
                        mean = np.add.reduceat(v[unit], starts, axis=0) / n[:, None]
                        out[rows, k * DIMS : (k + 1) * DIMS] = mean
                        out[rows, 2 * DIMS + k] = np.linalg.norm(mean, axis=1)
                    out[rows, 2 * DIMS + 2] = np.log1p(n)
                    distinct = np.unique((row << WORD_BITS) | word) >> WORD_BITS
                    out[rows, 2 * DIMS + 3] = np.bincount(distinct, minlength=len(part))[rows] / n
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * FEATURES, pa.int32()), pa.array(out.ravel()))
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), lists], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(pool, "doc_id long, features array<float>")


class Network:
    """Two layers, tanh and logistic, fitted by Adam; then one temperature."""

    def __init__(self, hidden: int = 32, seed: int = 5):
        self.hidden, self.rng = hidden, np.random.default_rng(seed)
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 3000, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = self.rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        check, train = (order[:cut], order[cut:]) if len(x) >= 10 else (order, order)
        z = (x - self.mean) / self.scale
        w = [self.rng.standard_normal((x.shape[1], self.hidden)) / np.sqrt(x.shape[1]), np.zeros(self.hidden), self.rng.standard_normal(self.hidden) / np.sqrt(self.hidden), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, steps + 1):
            pick = train[self.rng.integers(0, len(train), batch)]
            h = np.tanh(z[pick] @ w[0] + w[1])
            wrong = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[pick]) / batch
            back = np.outer(wrong, w[2]) * (1 - h * h)
            grads = [z[pick].T @ back + decay * w[0], back.sum(axis=0), h.T @ wrong + decay * w[2], wrong.sum(keepdims=True)]
            for p, g, a, b in zip(w, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (1 - step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.w = w
        logit, t = self.logits(x[check]), y[check]
        loss = {s: np.mean(np.logaddexp(0, logit / s) - t * logit / s) for s in np.exp(np.linspace(-1.5, 2.5, 81))}
        self.temperature = min(loss, key=loss.get)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def fit_network(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network fitted on at most ``sample`` labelled rows that aren't held out; None without any."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound on what reaches the driver
    # repeated rows of a doc_id are one example: the least features, at any size
    pairs = features.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("quality").alias("quality")).toPandas().sort_values(["doc_id"], kind="stable")
    if not len(pairs):
        return None
    return Network().fit(np.stack(pairs["features"].to_numpy()).astype("f8"), (pairs["quality"].to_numpy() >= 0.5).astype("f8"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7)."""
    features = stored(document_features(docs, word_vectors(docs)), "quality-features")
    network = fit_network(features, labels)
    table = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype("f8")
            p = table.value.probability(x) if table.value is not None else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted"))
