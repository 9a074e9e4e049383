"""The pipeline, stage by stage, against brute force on what each stage was given."""

import collections

import corpus_pipeline
from spanloom.llm import mixing, quality_rules, secrets
from spanloom.llm.common import stored
from tests.conftest import SF
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_text_operators import AWKWARD, DOCS, check_mix, check_packing, counts_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "test-stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]

    kept = {r["doc_id"] for r in quality_rules.quality_report(docs).where("kept").collect()}
    assert {r["doc_id"] for r in rows[1]} == kept and len(kept) < len(rows[0])
    assert all((c := counts_of(r["text"]))[0] >= 50 and 2 * c[4] <= c[0] for r in rows[1])

    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(set(classes.values()))

    before = {r["doc_id"]: r["text"] for r in rows[2]}
    assert {r["doc_id"]: r["text"] for r in rows[3]} == {d: secrets.redact(t) for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[3])
    assert not any(secrets.base_matches(r["text"]) for r in rows[3])

    report = mixing.mix_report(tables[3]).collect()
    check_mix(report, {r["doc_id"]: r["source"] for r in rows[3]})
    assert collections.Counter(r["doc_id"] for r in rows[4]) == collections.Counter({r["doc_id"]: r["copies"] for r in report if r["copies"]})

    n, least = check_packing(rows[5], [(r["doc_id"], r["text"]) for r in rows[4]])
    assert n <= 1.02 * least + 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mixing", "best-fit packing"]


def stages_of(spark, docs):
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "test-stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    return [t.collect() for t in tables]


def test_awkward_rows_through_all_stages(spark):
    """Nulls, empty and long texts, repeated rows and columns with the names of inner ones."""
    good = lambda k, n=90: " ".join(f"w{k}x{i}" for i in range(n))
    secret = good(9) + " password = hunter2hunter2 " + good(10)
    rows = [r for r in AWKWARD if r[0] != 5]
    rows += [(20, good(1), "en", "a", 1, "keep", 7), (20, good(1), "en", "a", 1, "keep", 7), (21, good(1), None, "b", 1, None, 8), (None, good(2), "en", None, None, "x", None), (22, secret, "en", None, 3, "y", 9), (23, good(3, 30_000), "de", "a", 5, "z", 1), (24, good(4), "en", "b", 5, "z", 1)]
    rows = stages_of(spark, spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] or 0 for r in rows[1]) == [0, 20, 20, 21, 22, 23, 24]
    assert collections.Counter(r["text"] for r in rows[2]) == {good(1): 1, good(2): 1, secret: 1, good(3, 30_000): 1, good(4): 1}
    assert {r["doc_id"]: (r["_counts"], r["bin"]) for r in rows[2] if r["doc_id"] in (22, 23, 24)} == {22: ("y", 9), 23: ("z", 1), 24: ("z", 1)}
    assert not any("hunter2" in r["text"] for r in rows[3]) and len(rows[3]) == 5
    kept = {r["text"] for r in rows[3]}
    assert {r["text"] for r in rows[4]} <= kept and rows[4]
    check_packing(rows[5], [(r["doc_id"], r["text"]) for r in rows[4]])


def test_empty_table_through_all_stages(spark):
    assert stages_of(spark, spark.createDataFrame([], DOCS)) == [[]] * 6
