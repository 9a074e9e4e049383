"""Held-out accuracy of the classifier; token counts against encoding whole texts again."""

import random
import zlib

import numpy as np

from spanloom.llm import common, quality_model, token_counts
from tests.conftest import SF
from tests.llm.test_text_operators import AWKWARD, DOCS


def auc(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_classifier_on_held_out_rows(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_model.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.95
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    again = quality_model.quality_scores(docs.repartition(3), labels).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"], atol=1e-5)


def test_classifier_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(docs, labels).count() == len(AWKWARD)
    assert {r["score"] for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def plain_count(text):
    return len(common.UnitEncoder.load(common.tokenizer_path()).whole([text])[0]) // 4


def plain_edit(text, edits):
    for a, b, t in sorted(edits, reverse=True):
        text = text[:a] + t + text[b:]
    return text


def test_counts_after_random_edits(spark):
    rng = random.Random(4)
    pieces = ["word", "Wörter", " ", " ", " ", "\n", "  ", "'s", "12", "!", "\t", "\xa0", "x"]
    rows = []
    for i in range(300):
        text = "".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 200, 1500])))
        marks = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 5)) // 2 * 2))
        edits = [(a, b, "".join(rng.choices(pieces, k=rng.randint(0, 4)))) for a, b in zip(marks[::2], marks[1::2], strict=True)]
        rows.append((i, text, edits, "extra"))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, note string")
    trees = token_counts.with_trees(df)
    got = {r["doc_id"]: r for r in token_counts.edited(trees).collect()}
    for i, text, edits, _ in rows:
        after = plain_edit(text, edits)
        r = got[i]
        assert (r["text"], r["n_tokens"], r["n_tokens_after"]) == (after, plain_count(text), plain_count(after)), (text, edits)
        assert sum(r["leaf_tokens"]) == r["n_tokens_after"] and sum(r["leaf_chars"]) == len(after) and r["note"] == "extra"


def test_edit_report(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r for r in token_counts.sample_edits(docs).collect()}
    again = total = 0
    for r in token_counts.edit_report(docs).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == plain_count(t["text"])
        assert r["n_tokens_after"] == plain_count(plain_edit(t["text"], [(e["start"], e["end"], e["text"]) for e in t["edits"]]))
        again, total = again + r["reencoded_chars"], total + len(t["text"])
    assert again < 0.6 * total
    awkward = spark.createDataFrame(AWKWARD, DOCS)
    assert token_counts.edit_report(awkward).count() == len(AWKWARD)
    assert token_counts.edit_report(awkward.limit(0)).count() == 0


def test_tree_finds_leaves():
    tree = token_counts.SegmentTree([3, 4, 5], [1, 1, 2])
    assert [tree.leaf_at(c) for c in (0, 2, 3, 7, 11, 99)] == [(0, 0), (0, 0), (1, 3), (2, 7), (2, 7), (2, 7)]
    tree.update(1, 1, 5)
    assert tree.tokens == 8 and tree.leaf_at(4) == (2, 4)
