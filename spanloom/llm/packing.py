"""Best-fit packing of token pieces into sequences of fixed capacity.

Documents are tokenized and cut into pieces of at most ``capacity`` ids. Full
pieces are sequences already. The others are packed in rounds: each partition
packs its own bins best-fit, largest first, and emits those that are full or
lack at most ``slack`` ids. Underfull bins that can still be merged become the
items of the next round, in ``FAN_IN`` times fewer partitions, like the merges of
a tree, until all that is left was in one. A partition of the first round holds
about ``per_task`` items, whatever the corpus; in later rounds the bins of one
fill are at most as many as the partitions merged into it times those of the
round before. Bins are moved by a hash of their number, so none is hot.

Defined results: null text counts as empty (one piece, the end id alone);
repeated rows and ids are separate documents; an empty table gives no rows;
other columns are ignored. Bins are numbered by round, partition and place, and
each partition is sorted before it is packed, so a task that runs again gives
the same rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitEncoder, released, stored, tokenizer_path

FAN_IN = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINNED = f"{PIECE}, bin long, offset long, fill long"


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (and end id), with a bin number each. ``with_ids`` adds the ids themselves."""
    path = tokenizer or tokenizer_path()

    def cut(batches):
        import zlib

        import pyarrow as pa

        encoder = UnitEncoder.load(path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, ends = encoder.encode(batch.column(1).fill_null(""))
            rows = batch.num_rows
            whole = np.insert(ids, ends[1:], end_id).astype("<u4")
            begin = ends[:-1] + np.arange(rows)
            total = np.diff(ends) + 1
            n = (total + capacity - 1) // capacity
            first = total - (n - 1) * capacity
            doc = np.repeat(np.arange(rows), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = begin[doc] + start
            view = memoryview(whole)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            bins = number + np.arange(len(doc))
            number += len(doc)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(bins, pa.int64()), pa.array(np.zeros(len(doc), "i8")), pa.array(length, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            if with_ids:
                # pieces follow one another in the batch's ids
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.astype("i4"))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(cut), BINNED + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ``sizes`` must fall. Free room is kept as bits of one integer, so a fit is a shift away."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins, where, offset = 0, 0, np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
    for i, s in enumerate(sizes.tolist()):
        m = free >> s
        if m:
            room = s + (m & -m).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        stacks[room - s].append(b)
        free |= 1 << (room - s)
    return where, offset


def _round(rows: DataFrame, parts: int, number: int, capacity: int, slack: int, last: bool) -> DataFrame:
    def pack(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        bins, fill = t.column("bin").to_numpy(), t.column("fill").to_numpy()
        distinct, first, inverse = np.unique(bins, return_index=True, return_inverse=True)
        size = fill[first]
        order = np.lexsort((distinct, -size))
        where, offset = np.empty(len(order), "i8"), np.empty(len(order), "i8")
        where[order], offset[order] = best_fit(size[order], capacity)
        total = np.bincount(where, weights=size).astype("i8")
        base = (number << 56) | (TaskContext.get().partitionId() << 33)
        new = where[inverse]
        # of the bins of one fill over half, those beyond the number of partitions can't be asked for
        by_fill = np.lexsort((np.arange(len(total)), total))
        place = np.arange(len(total)) - np.searchsorted(total[by_fill], total[by_fill])
        spare = np.zeros(len(total), bool)
        spare[by_fill] = (place >= parts) & (2 * total[by_fill] > capacity)
        done = (total >= capacity - slack) | spare | last
        done = done[new]
        t = t.set_column(5, "bin", pa.array(base + new)).set_column(6, "offset", pa.array(t.column("offset").to_numpy() + offset[inverse])).set_column(7, "fill", pa.array(total[new]))
        yield from t.append_column("done", pa.array(done)).to_batches()

    return rows.repartition(parts, "bin").mapInArrow(released(pack), BINNED + ", done boolean")


def packed(pieces: DataFrame, capacity: int = 1024, slack: int = 2, per_task: int = 100_000) -> DataFrame:
    """Pieces with the sequence each is in and its offset there. ``pieces``: a stored table of ``token_pieces``.

    Best fit leaves at most one bin of half the capacity or less in a partition, as two would
    have gone together. Only such small bins can still be merged, so of the larger bins of one
    fill as many stay open as there are partitions that could hold a small one, and none that
    the smallest open bin doesn't fit into: all others are final, and no fit is lost by it.
    """
    out = [pieces.where(F.col("fill") >= capacity)]
    open_ = pieces.where(F.col("fill") < capacity).select(*[c.split()[0] for c in BINNED.split(", ")])
    items, number = open_.count(), 1
    parts = max(1, math.ceil(items / per_task))
    while items:
        last = parts == 1
        now = stored(_round(open_, parts, number, capacity, slack, last), f"packing-{number}")
        out.append(now.where("done").drop("done"))
        if last:
            break
        least = now.where("not done").agg(F.min("fill")).first()[0]
        if least is None:
            break
        fits = ~F.col("done") & ((F.col("fill") + least <= capacity) | (F.col("fill") == least))
        out.append(now.where(~F.col("done") & ~fits).drop("done"))
        open_ = now.where(fits).drop("done")
        parts, number = max(1, math.ceil(parts / FAN_IN)), number + 1
    rows = reduce(DataFrame.unionByName, out)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, slack: int = 2, per_task: int = 100_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(stored(token_pieces(docs, capacity, end_id, tokenizer), "pieces"), capacity, slack, per_task)


def packed_sequences(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row a sequence: sequence_id, ids (at most ``capacity``), doc_ids of its pieces in order."""
    pieces = stored(token_pieces(docs, capacity, end_id, tokenizer, with_ids=True), "pieces")
    # a document's rows may repeat, so pieces are told apart by their first bin number
    keyed = pieces.select("bin", "ids")
    placed = packed(pieces.drop("ids").withColumn("doc_id", F.col("bin")), capacity)
    names = pieces.select("bin", F.col("doc_id").alias("real"))
    rows = placed.join(keyed, placed.doc_id == keyed.bin).drop("bin").join(names, F.col("doc_id") == names.bin)
    one = F.sort_array(F.collect_list(F.struct("offset", "ids", "real")))
    return rows.groupBy("sequence_id").agg(one.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["real"]).alias("doc_ids"))
