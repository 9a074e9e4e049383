"""Phrase collocation mining with counting quotient filters.

Texts are cut into pieces and words by numpy over whole Arrow batches; words are
counted by language, those of ``least`` occurrences or more are numbered, and
texts are written once as word numbers (0: a rarer word or a piece's end; a phrase
with either can't be frequent). For each size from 2 on, tasks fill counting
quotient filters of packed numbers (see ``quotient_filter``) and write one for
each shard; a shard's filters lie together after one shuffle and are merged in
sorted order. A phrase enters a filter only if its first and last words without
the other end are frequent, by a bitmap of at most ``BITMAP`` bits of the phrases
one word shorter: its false positives cost work, not results. The permutation
deals phrases evenly to shards and a phrase is one entry in each task's filter, so
a very common phrase is no hot key. Scores are native decimals.

Numbers of at most ``VOCABULARY`` words are broadcast; beyond that they are joined
to the words by a shuffle. 2**25 frequent words can be numbered at most, more raise
an error.

Defined results: null texts are empty; a null lang is ``und``; texts of any
length are read whole; repeated rows count each time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import stored
from .shingles import mix

LEAST, LONGEST, TOP = 100, 5, 2000
VOCABULARY, BITMAP, FILL, SHARD_WORDS, PART = 300_000, 1 << 27, 1_500_000, 500_000, 50_000
U = np.uint64
#: 0: part of a word; 1: between words; 2: between pieces.
_KIND = np.zeros(256, "u1")
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype="u1")
_LOWER[ord("A") : ord("Z") + 1] += 32
_NUMBERS: dict[str, dict] = {}


def cut(texts):
    """(row of each word, whether a piece begins there, words as a dictionary array) of a non-null Arrow string array."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, "u1")
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, "i8"), np.zeros(0, bool), pa.array([], pa.large_string()).dictionary_encode()
    kind = _KIND[data]
    solid = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    stops = np.flatnonzero(kind == 2)
    before = np.searchsorted(stops, starts)
    begins = np.ones(len(row), bool)
    begins[1:] = (before[1:] != before[:-1]) | (row[1:] != row[:-1])
    places = np.zeros(len(starts) + 1, "i8")
    np.cumsum(ends - starts, out=places[1:])
    letters = np.ascontiguousarray(_LOWER[data[solid]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return row, begins, words.dictionary_encode()


def _chunks(batches, most: int = 4_000_000):
    """(languages, texts) of about ``most`` bytes; a longer text is a chunk of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
            yield batch.column(0).slice(lo, hi - lo).dictionary_encode(), batch.column(1).slice(lo, hi - lo)
            lo = hi


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def count(batches):
        import pyarrow as pa

        for langs, texts in _chunks(batches):
            row, _, words = cut(texts)
            names, distinct = langs.dictionary, words.dictionary
            if not len(row):
                continue
            key = langs.indices.to_numpy()[row].astype("i8") * len(distinct) + words.indices.to_numpy()
            if len(names) * len(distinct) < 4 * len(key) + 1000:
                n = np.bincount(key, minlength=len(names) * len(distinct))
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            yield pa.record_batch([names.take(pa.array(key // len(distinct))).cast(pa.string()), distinct.take(pa.array(key % len(distinct))).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return _texts(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, c) of the words of ``least`` occurrences or more, ids from 1 without gaps."""
    placed = stored(words.where(F.col("n") >= least).select("lang", "word", F.col("n").alias("c"), F.monotonically_increasing_id().alias("_m")), "collocation-words")
    part = F.shiftright("_m", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = placed.sparkSession.createDataFrame(starts, "_p long, _o long")
    low = F.col("_m").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), part == F.col("_p")).select((F.col("_o") + low + 1).alias("id"), "lang", "word", "c")


def _joined_numbers(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Word numbers (ids array<int>) of each text, by a join of all words with the vocabulary."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for langs, texts, rows in ((batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1)) for i in range(batch.num_rows)):
                _, begins, words = cut(texts)
                place = np.arange(len(begins)) + np.cumsum(begins)
                many = pa.array(np.zeros(len(begins), "i4"))
                yield pa.record_batch([langs.take(many), words.dictionary.take(words.indices).cast(pa.string()), rows.take(many), pa.array(place, pa.int64())], names=["lang", "word", "row", "place"])

    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(spread, "lang string, word string, row long, place long")
    said = rows.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("w"))
    led = F.zip_with("w", F.concat(F.array(F.lit(None).cast("struct<place:bigint,id:bigint>")), F.slice("w", 1, F.size("w") - 1)), lambda x, y: F.when(x["place"] == y["place"] + 1, F.array(x["id"])).otherwise(F.array(F.lit(0).cast("long"), x["id"])))
    return said.select(F.flatten(led).cast("array<int>").alias("ids"))


def word_numbers(docs: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """(ids array<int>) of each text that has neighbouring frequent words; 0 where a phrase must end."""
    if vocabulary.count() > most:
        return _joined_numbers(docs, vocabulary)
    known = vocabulary.select("lang", "word", "id").toArrow()  # at most ``most`` rows
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, known.combine_chunks()))

    def number(batches):
        import pyarrow as pa

        name, rows = held.value
        if name not in _NUMBERS:
            _NUMBERS.clear()
            table = _NUMBERS[name] = {}
            for lang, word, n in zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True):
                table.setdefault(lang, {})[word] = n
        table = _NUMBERS[name]
        for langs, texts in _chunks(batches):
            row, begins, words = cut(texts)
            if not len(row):
                continue
            lang_of, at = langs.indices.to_numpy()[row], words.indices.to_numpy()
            distinct, ids = words.dictionary.to_pylist(), np.zeros(len(row), "i4")
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                get = table.get(lang, {}).get
                here = lang_of == k if len(langs.dictionary) > 1 else slice(None)
                ids[here] = np.fromiter((get(w, 0) for w in distinct), "i4", len(distinct))[at[here]]
            pair = np.zeros(len(ids) + 1, bool)  # words k - 1 and k stand together
            pair[1:-1] = (ids[1:] > 0) & (ids[:-1] > 0) & ~begins[1:]
            used = pair[1:] | pair[:-1]
            opens = np.flatnonzero(used & ~pair[:-1])  # each run of words is led by a 0
            flat = np.insert(ids[used], (np.cumsum(used) - 1)[opens], 0)
            rows = np.insert(row[used], (np.cumsum(used) - 1)[opens], row[opens])
            ends = np.searchsorted(rows, np.unique(rows), "right")
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int32()))], names=["ids"])

    return _texts(docs).mapInArrow(number, "ids array<int>")


def _slot(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return (mix(left * U(0xD6E8FEB86659FD93) + right) & U(bits - 1)).astype("i8")


def _marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63).astype(U)) & U(1) > 0


def frequent_bitmap(grams: DataFrame, size: int, bits: int) -> np.ndarray | None:
    """A bitmap of the frequent phrases (ids) of one size, 16 bits each up to BITMAP in all."""
    n = grams.count()
    if not n:
        return None
    width = 1 << min(BITMAP.bit_length() - 1, max(10, math.ceil(math.log2(16 * n))))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                g = batch.column(0).flatten().to_numpy().reshape(-1, size)
                slots = _slot(*qf.packed(list(g.T), bits), width)
                yield pa.record_batch([pa.array(slots >> 6, pa.int32()), pa.array(1 << (slots & 63).astype("u8"), pa.uint64()).view(pa.int64())], names=["word", "bit"])

    marks = grams.select("ids").mapInArrow(place, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(width >> 6, U)
    bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy().view("u8")
    return bitmap


def phrase_counts(texts: DataFrame, size: int, bits: int, bitmaps: list[np.ndarray], shard_bits: int, least: int) -> DataFrame:
    """(ids array<int>, f): phrases of one size of ``least`` occurrences or more in word numbers (ids), by merged filters."""
    half = qf.half_bits(size, bits)
    shard_bits = min(shard_bits, half)
    held = texts.sparkSession.sparkContext.broadcast(bitmaps)  # at most BITMAP bits for each smaller size

    def fill(batches):
        import pyarrow as pa

        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def filters():
            left, right, counts = qf.summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), None, half)
            parts.clear()
            shard = (left >> U(half - shard_bits)).astype("i8")
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(left) else []
            edges = [*first, len(left)]
            data = [qf.encoded(left[a:b], right[a:b], counts[a:b], half, shard_bits) for a, b in zip(edges, edges[1:], strict=False)]
            return pa.record_batch([pa.array(shard[first] if len(left) else [], pa.int64()), pa.array(data, pa.binary())], names=["shard", "filter"])

        for batch in batches:
            ids = batch.column(0).flatten().to_numpy()
            fine = ids > 0
            stops = np.cumsum(pa.compute.list_value_length(batch.column(0)).to_numpy())
            last = np.zeros(len(ids) + 1, bool)
            last[stops] = True
            # good[i]: a phrase of k words may begin at i
            good = fine[:-1] & fine[1:] & ~last[1 : len(ids)]
            for k in range(2, size):
                at = np.flatnonzero(good)
                found = _marked(held.value[k - 2], _slot(*qf.packed([ids[at + j] for j in range(k)], bits), len(held.value[k - 2]) << 6))
                good[at[~found]] = False
                good = good[:-1] & good[1:]
            at = np.flatnonzero(good)
            for lo in range(0, len(at), FILL):
                some = at[lo : lo + FILL]
                parts.append(qf.permuted(*qf.packed([ids[some + j] for j in range(size)], bits), half))
                if sum(len(p[0]) for p in parts) >= FILL:
                    yield filters()
        if parts:
            yield filters()

    def merge(batches):
        import pyarrow as pa

        def whole(shard, filters):
            left, right, counts = qf.merged(filters, half)
            kept = counts >= least
            grams = qf.unpacked(*qf.restored(left[kept], right[kept], half), size, bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(grams) + 1, size), pa.int32()), pa.array(grams.ravel(), pa.int32()))
            return pa.record_batch([lists, pa.array(counts[kept], pa.int64())], names=["ids", "f"])

        now, held_, pending = None, [], 0
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if held_:
                        yield whole(now, held_)
                    now, held_, pending = shard, [], 0
                new = qf.decoded(data, half, shard, shard_bits)
                held_.append(new)
                pending += len(new[0])
                if pending > FILL:  # what is merged stays one filter
                    held_, pending = [qf.merged(held_, half)], 0
        if held_:
            yield whole(now, held_)

    filled = texts.mapInArrow(fill, "shard long, filter binary")
    return filled.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "ids array<int>, f long")


def scored(grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of phrases (ids, f) that no longer one covers; ``vocabulary`` with n, the words of the language."""
    size = F.size("ids")
    cuts = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"_left": F.slice("ids", 1, F.col("k")), "_right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    words = vocabulary.select(F.array(F.col("id").cast("int")).alias("ids"), F.col("c").alias("f"), "lang", "n")
    parts = words.unionByName(grams.select("ids", "f"), allowMissingColumns=True)
    cuts = cuts.join(parts.select(F.col("ids").alias("_left"), F.col("f").alias("l"), "lang", "n"), "_left").join(parts.select(F.col("ids").alias("_right"), F.col("f").alias("r")), "_right")
    each = cuts.groupBy("ids").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    long = lambda c: c.cast("decimal(19,0)")
    score = lambda c: F.call_function("div", long(F.col("a")) * long(F.col("n") * 1000), long(c["l"]) * long(c["r"]))
    best = F.array_min(F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    found = each.withColumn("_b", best).select("lang", "ids", "a", "_b.l", "_b.r", "n", "_b.score")
    # a longer phrase that covers one covers all between them, so its two ends are enough
    longer = grams.where(size > 2).select("f", F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"))
    cover = longer.groupBy("ids").agg(F.max("f").alias("_cover"))
    return found.join(cover, "ids", "left").where(F.col("_cover").isNull() | (F.col("_cover") < F.col("a"))).drop("_cover")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_words: int = VOCABULARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of documents (text, lang)."""
    spark = docs.sparkSession
    words = stored(word_counts(docs), "collocation-counts")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = stored(numbered(words, least).join(sizes, "lang"), "collocation-vocabulary")
    total = words.agg(F.sum("n")).first()[0] or 0
    most = vocabulary.agg(F.max("id")).first()[0] or 0
    bits = max(1, int(most).bit_length())
    shard_bits = min(20, max(0, math.ceil(math.log2(max(1, total / SHARD_WORDS)))))
    grams, bitmaps = spark.createDataFrame([], "ids array<int>, f long"), []
    if most:
        texts = stored(word_numbers(docs, vocabulary, most_words), "collocation-texts")
        for size in range(2, longest + 1):
            found = stored(phrase_counts(texts, size, bits, bitmaps, shard_bits, least), f"collocations-{size}")
            bitmap = frequent_bitmap(found, size, bits) if size < longest else None
            grams = found if size == 2 else grams.unionByName(found)
            if bitmap is None:
                break
            bitmaps.append(bitmap)
    rows = stored(scored(grams, vocabulary), "collocation-scores")
    # the best by score and count with all ties, in ever fewer parts of a language; then phrases settle the ties
    order = (F.desc("score"), F.desc("a"))
    parts = max(1, math.ceil(rows.count() / PART))
    while True:
        part = F.pmod(F.xxhash64("ids"), F.lit(parts)).alias("_part")
        rows = rows.withColumn("_p", F.rank().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("_p") <= top).drop("_p")
        if parts == 1:
            break
        parts = math.ceil(parts * top / PART)
    said = rows.select("ids", F.posexplode("ids").alias("k", "id")).join(vocabulary.select("id", "word"), "id")
    said = said.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = rows.join(said, "ids").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
