"""Timed words: two encodings of transcripts and the words table.

Signed: a list of milliseconds; a value of 0 or more is a word's duration, a
negative one a silence. Pairs: (gap, duration) for each word, the first gap
being the absolute start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import SPACES


def decode_signed(df: DataFrame, key: str = "doc_id", timings: str = "timings", start_ms: str = "start_ms") -> DataFrame:
    """(key, pos, start_ms, end_ms) of the words of signed lists."""
    rows = df.select(key, F.col(start_ms).alias("_zero"), F.posexplode(timings).alias("_k", "_v"))
    upto = W.partitionBy(key).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    timed = rows.select(key, "_v", (F.sum(F.when(F.col("_v") >= 0, 1).otherwise(0)).over(upto) - 1).cast("int").alias("pos"), (F.col("_zero") + F.sum(F.abs("_v")).over(upto)).alias("end_ms"))
    return timed.where("_v >= 0").select(key, "pos", (F.col("end_ms") - F.col("_v")).alias("start_ms"), "end_ms")


def encode_signed(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_ms, timings) of words (pos, start_ms, end_ms). Overlaps aren't stored, so they drift."""
    ordered = W.partitionBy(key).orderBy("pos")
    gap = F.col("start_ms") - F.lag("end_ms").over(ordered)
    parts = F.when(gap > 0, F.array((-gap).cast("long"), (F.col("end_ms") - F.col("start_ms")).cast("long"))).otherwise(F.array((F.col("end_ms") - F.col("start_ms")).cast("long")))
    rows = words.withColumn("_parts", parts).groupBy(key).agg(F.min_by("start_ms", "pos").alias("start_ms"), F.sort_array(F.collect_list(F.struct("pos", "_parts"))).alias("_p"))
    return rows.select(key, "start_ms", F.flatten(F.transform("_p", lambda p: p["_parts"])).alias("timings"))


def encode_pairs(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, timings) as (gap, duration) pairs; the first gap is the start itself."""
    ordered = W.partitionBy(key).orderBy("pos")
    gap = F.greatest(F.col("start_ms") - F.coalesce(F.lag("end_ms").over(ordered), F.lit(0)), F.lit(0)).cast("long")
    rows = words.withColumn("_parts", F.array(gap, (F.col("end_ms") - F.col("start_ms")).cast("long")))
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "_parts"))).alias("_p"))
    return rows.select(key, F.flatten(F.transform("_p", lambda p: p["_parts"])).alias("timings"))


def decode_pairs(df: DataFrame, key: str = "doc_id", timings: str = "timings") -> DataFrame:
    """(key, pos, start_ms, end_ms) of the words of pair lists."""
    rows = df.select(key, F.posexplode(timings).alias("_k", "_v"))
    upto = W.partitionBy(key).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    timed = rows.select(key, "_k", "_v", F.sum("_v").over(upto).alias("end_ms")).where("_k % 2 = 1")
    return timed.select(key, F.floor(F.col("_k") / 2).cast("int").alias("pos"), (F.col("end_ms") - F.col("_v")).alias("start_ms"), "end_ms")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where they come in fewer partitions (a scan of few row groups); untouched otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _words(texts):
    """(row, place, word, first byte, last byte) of the words of an Arrow string array, row by row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(texts.fill_null("").cast(pa.large_string()), pattern=SPACES)
    row, flat = pc.list_parent_indices(lists), lists.flatten()
    full = pc.not_equal(flat, "")
    row, flat = row.filter(full).to_numpy(), flat.filter(full)
    size = pc.binary_length(flat).to_numpy()
    place = np.arange(len(row)) - np.searchsorted(row, row)
    end = np.cumsum(size + 1)
    end = end - (end - size - 1)[np.searchsorted(row, row)] - 1 if len(row) else end
    return row, place, flat, end - size, end


def text_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, word, byte_start, byte_end); bytes count in the text of all words joined by blanks.

    A text's words come from one row, so no shuffle is needed for their places.
    """

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                row, place, word, first, last = _words(part.column(1))
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(place, pa.int32()), word.cast(pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=[key, "pos", "word", "byte_start", "byte_end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(cut, f"{key} {kind}, pos int, word string, byte_start long, byte_end long")


def word_lists(transcripts: DataFrame, key: str = "doc_id", text: bool = False) -> DataFrame:
    """(key, ws): the words of ``words_table`` as one list of structs a text, for what looks at a word's neighbours. With
    ``text`` the text as well."""
    return words_table(transcripts, key, listed=True, text=text)


def words_table(transcripts: DataFrame, key: str = "doc_id", following: bool = False, listed: bool = False, text: bool = False) -> DataFrame:
    """Words with times and bytes of transcripts (text, start_ms, timings, encoding 'signed' or 'pairs').

    Words beyond the timings have null times. Both lists lie in one row, so nothing is shuffled. With ``following``
    each word has the next one of its text as ``next_word``. With ``listed`` a text's words are one list, ``ws``,
    with ``text`` beside the text.
    """

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                row, place, word, first, last = _words(part.column(1))
                zero = part.column(2).fill_null(0).to_numpy()
                signed = part.column(4).fill_null("").to_numpy(zero_copy_only=False) == "signed"
                lists = part.column(3)
                at = pc.list_parent_indices(lists).to_numpy().astype("i8")
                v = lists.flatten().fill_null(0).to_numpy()
                begins = np.searchsorted(at, at)
                k = np.arange(len(at)) - begins
                run = np.cumsum(np.abs(v))
                run = run - (run - np.abs(v))[begins] if len(at) else run
                heard = np.where(signed[at], v >= 0, k % 2 == 1)
                nth = np.cumsum(heard)
                nth = nth - (nth - heard)[begins] - 1 if len(at) else nth
                end = run + np.where(signed[at], zero[at], 0)
                counts = np.bincount(row, minlength=part.num_rows)
                use = heard & (nth < counts[at])
                target = (np.cumsum(counts) - counts)[at[use]] + nth[use]
                known = np.zeros(len(row), bool)
                start_ms, end_ms = np.zeros(len(row), "i8"), np.zeros(len(row), "i8")
                known[target], end_ms[target], start_ms[target] = True, end[use], end[use] - v[use]
                columns = [part.column(0).take(pa.array(row)), pa.array(place, pa.int32()), word.cast(pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(start_ms, mask=~known), pa.array(end_ms, mask=~known)]
                if following:
                    n = len(row)
                    ends = np.append(row[1:] != row[:-1], True) if n else np.zeros(0, bool)
                    columns.append(columns[2].take(pa.array(np.minimum(np.arange(n) + 1, max(n - 1, 0)), mask=ends)))
                if listed:
                    bounds = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                    columns = [part.column(0), pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns[1:], names=names[1:])), *[part.column(1)] * text]
                yield pa.record_batch(columns, names=[key, "ws", *["text"] * text] if listed else names)

    kind = transcripts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pos int, word string, byte_start long, byte_end long, start_ms long, end_ms long" + (", next_word string" if following else "")
    names = [key, "pos", "word", "byte_start", "byte_end", "start_ms", "end_ms", *["next_word"] * following]
    if listed:
        schema = f"{key} {kind}, ws array<struct<{schema.partition(', ')[2].replace(' ', ': ').replace(',:', ',')}>>" + ", text string" * text
    rows = transcripts.select(key, F.col("text").cast("string"), F.col("start_ms").cast("long"), F.col("timings").cast("array<long>"), "encoding")
    return rows.mapInArrow(cut, schema)
