"""Exact round trips of blocks and files."""

import zlib

import numpy as np
import pytest

from spanloom.llm import common, range_coder, token_files
from tests.conftest import SF
from tests.llm.test_text_operators import AWKWARD, DOCS, plain_ids


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 50_257, 200_000])
def test_blocks_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    blocks = [rng.integers(0, vocabulary, n).astype("u4") for n in (0, 1, 2, 5, 700, 64, 65)]
    blocks += [np.full(900, vocabulary - 1, "u4"), np.tile(blocks[4][:7], 100), np.minimum(rng.zipf(1.3, 1500) - 1, vocabulary - 1).astype("u4")]
    coded = range_coder.encode_blocks(blocks, vocabulary)
    for got in (range_coder.decode_blocks(coded, vocabulary), [range_coder.decode_blocks([c], vocabulary)[0] for c in coded]):
        assert all(np.array_equal(a, b) for a, b in zip(got, blocks, strict=True))
    assert range_coder.split_blocks(b"".join(coded)) == coded
    assert range_coder.encode_blocks([], vocabulary) == [] == range_coder.decode_blocks([], vocabulary)


def test_repeats_cost_little():
    ids = np.tile(np.arange(100, 150, dtype="u4") * 300, 80)
    assert len(range_coder.encode_blocks([ids], 50_257)[0]) < 0.1 * 2 * len(ids)


def test_blocks_of_texts_are_smaller_than_zlib_makes_them():
    """64 whole blocks of ids of the test documents, in order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    ids, _ = common.UnitEncoder.load(common.tokenizer_path()).encode(texts)
    blocks = [ids[k : k + range_coder.BLOCK].astype("u4") for k in range(0, 64 * range_coder.BLOCK, range_coder.BLOCK)]
    coded = range_coder.encode_blocks(blocks, 50_257)
    ours, theirs = sum(map(len, coded)), sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    print("bits an id", ours * 8 / (64 * range_coder.BLOCK), "zlib", theirs * 8 / (64 * range_coder.BLOCK))
    assert ours < 0.95 * theirs


def test_damage_is_found():
    block = range_coder.encode_blocks([np.arange(500, dtype="u4")], 50_257)[0]
    for bad in (block[:-4], b"XXXX" + block[4:]):
        with pytest.raises(range_coder.BadBlock):
            range_coder.split_blocks(bad)
    with pytest.raises(range_coder.BadBlock):
        range_coder.decode_blocks([block[:40] + bytes([block[40] ^ 8]) + block[41:]], 50_257)


def check_files(df, rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for (d, _), i in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        ids = np.array([*i, 2], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = sorted(map(tuple, token_files.token_file_report(df).collect()), key=lambda r: r[1])
    assert got == want


def test_files_round_trip(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_files(df, [(r["doc_id"], r["text"]) for r in df.collect()])
    awkward = spark.createDataFrame(AWKWARD, DOCS)
    check_files(awkward, [(r[0], r[1]) for r in AWKWARD])
    assert token_files.token_file_report(awkward.limit(0)).count() == 0
