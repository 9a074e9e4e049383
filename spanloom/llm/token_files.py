"""Token ids in files of range-coded blocks, in ascending doc_id order.

Documents are dealt by ranges of doc_id and sorted, tokenized (an end id after
each) and cut into segments of whole documents with at least ``SEGMENT`` ids. A
segment is a row: its part and place, the ids before it in its part, doc_ids and
lengths of its documents, and its blocks (see ``range_coder``), which any reader
can decode alone. The container is Parquet, so files can lie in any store that
Spark writes to; only the number of ids of each part passes the driver.

Defined results: null text counts as empty (the end id alone); a null doc_id
comes first; rows of one doc_id are ordered by text and kept; an empty table
gives no rows; other columns are ignored. A document is in one segment, so one
document must fit in a task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UnitEncoder, shared_dir, text_or_empty, tokenizer_path
from .range_coder import BLOCK, decode_blocks, encode_blocks, split_blocks

SEGMENT, TOGETHER = 1 << 16, 2048
VOCABULARY = 50_257
FORMAT = "part int, segment long, start long, doc_ids array<long>, n_tokens array<long>, payload binary"


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)]


def encoded_segments(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """Rows of the file format from documents, sorted by doc_id within and over parts."""
    path = tokenizer or tokenizer_path()

    def encode(batches):
        import pyarrow as pa

        encoder = UnitEncoder.load(path)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        ready: list[tuple[list, list[np.ndarray]]] = []

        def flush():
            nonlocal number, start
            cut = [_blocks(np.concatenate(arrays)) for _, arrays in ready]
            coded = iter(encode_blocks([x for c in cut for x in c], vocabulary))
            rows = []
            for (ids, arrays), c in zip(ready, cut, strict=True):
                lens = [len(a) for a in arrays]
                rows.append((part, number, start, ids, lens, b"".join(next(coded) for _ in c)))
                number, start = number + 1, start + sum(lens)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=FORMAT.replace(",", "").split()[::2])

        size = blocks = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                few = batch.slice(lo, 2000)
                ids, ends = encoder.encode(few.column(1))
                for name, a, b in zip(few.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    names.append(name)
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    size += b - a + 1
                    if size >= SEGMENT:
                        ready.append((names, held))
                        blocks += -(-size // BLOCK)
                        names, held, size = [], [], 0
                        if blocks >= TOGETHER:
                            yield flush()
                            blocks = 0
        if held:
            ready.append((names, held))
        if ready:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encode, FORMAT)


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, vocabulary: int = VOCABULARY) -> None:
    encoded_segments(docs, end_id, tokenizer, vocabulary).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, vocabulary: int = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and its ids."""
    files = spark.read.schema(FORMAT).parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before, at = [], 0
    for r in sorted(totals.collect()):  # one row a part
        before.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                todo, rows = [], []
                while lo < batch.num_rows and len(todo) < TOGETHER:
                    blocks = split_blocks(batch.column(3)[lo].as_py())
                    rows.append((lo, len(blocks)))
                    todo += blocks
                    lo += 1
                got = iter(decode_blocks(todo, vocabulary))
                for row, n in rows:
                    ids = np.concatenate([next(got) for _ in range(n)])
                    lens = batch.column(2)[row].values.to_numpy()
                    ends = np.cumsum(lens)
                    cut = [ids[b - n : b] for b, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                    columns = [batch.column(1)[row].values, pa.array(ends - lens + batch.column(0)[row].as_py()), pa.array(lens, pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([c.astype("i4") for c in cut], pa.list_(pa.int32())))
                    yield pa.record_batch(columns, names=schema.replace(",", "").split()[::2])

    placed = files.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "n_tokens", "payload")
    return placed.mapInArrow(decode, schema)


def token_file_report(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Writes the files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, end_id, tokenizer)
    return read_token_files(docs.sparkSession, path, with_ids=False)
