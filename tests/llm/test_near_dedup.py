"""Near-duplicates against brute force over all pairs."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import near_dedup as nd
from spanloom.llm.shingles import shingles
from tests.conftest import SF
from tests.llm.test_text_operators import AWKWARD, DOCS


def brute_classes(rows):
    """doc_id -> class by exact weighted Jaccard over all pairs."""
    texts = [t or "" for _, t in rows]
    row, s, times = shingles(pa.array(texts))
    table = np.bincount((s >> np.uint64(28)).astype("i8"), minlength=1 << 20)
    w = nd.weights(s, times, nd.idf_table(table, len(texts)))
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    sets = [(s[a:b], w[a:b]) for a, b in itertools.pairwise(cut)]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = collections.defaultdict(list)
    for i, (x, _) in enumerate(sets):
        for v in x.tolist():
            holders[v].append(i)
    near = {(a, b) for h in holders.values() for a, b in itertools.combinations(h, 2)}
    first = {}
    for i, t in enumerate(texts):
        near.add((first.setdefault(t, i), i))
    for a, b in near:
        if texts[a] == texts[b] or nd.weighted_jaccard(sets[a], sets[b]) >= 0.8:
            group[max(root(a), root(b))] = min(root(a), root(b))
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[root(i)].append(d)
    return {d: min((x for x in names[root(i)] if x is not None), default=None) for i, (d, _) in enumerate(rows)}


def test_shingles_equal_plain_ones():
    texts = ["", "a b", " a  b c d e f a b c d e f", "é \n x y z w é", "one"]
    row, s, times = shingles(pa.array(texts))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        plain = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else {}
        assert sorted(times[row == i].tolist()) == sorted(plain.values())
    again, t2, _ = shingles(pa.array(["x", texts[2]]))
    assert t2[again == 1].tolist() == s[row == 2].tolist()


def test_samples_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 48, 400)).astype("u8")
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 1 << 48, 100).astype("u8")]))
    wa, wb = (1 + (a % np.uint64(3))).astype("f4"), (1 + (b % np.uint64(3))).astype("f4")
    n = 3000
    x, y = nd.samples(np.zeros(400, "i8"), a, wa, n), nd.samples(np.zeros(400, "i8"), b, wb, n)
    assert abs((x == y).mean() - nd.weighted_jaccard((a, wa), (b, wb))) < 0.03


@pytest.mark.parametrize("name", ["documents", "made"])
def test_classes_equal_brute_force(spark, name):
    if name == "documents":
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    else:
        rng = np.random.default_rng(1)
        base = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{i}{k}" for k, w in enumerate(base))) for i in range(60)]
        shared = " ".join(f"s{i}" for i in range(60))
        rows += [(100 + i, shared + " " + " ".join(f"y{i}_{k}" for k in range(100))) for i in range(60)]
        rows += [(200 + i, "same text again") for i in range(50)] + [(300, None), (301, ""), (302, " "), (302, " ")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_classes(rows)
    got = [(r["doc_id"], r["class_id"]) for r in nd.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    assert dict(got) == want
    kept = sorted(r["doc_id"] for r in nd.deduplicated(df).collect())
    assert kept == sorted(set(want.values()))


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    got = nd.near_duplicates(df).collect()
    assert len(got) == len(AWKWARD)
    assert nd.deduplicated(df).columns == df.columns
    assert nd.deduplicated(df).count() == len({r[1] or "" for r in AWKWARD})
    assert nd.near_duplicates(df.limit(0)).count() == 0


def crafted(spark, texts, bands):
    """Links, as pairs of names, between texts whose band keys are given as name -> {band: key}; all other keys are their own."""
    own = iter(range(10**6, 2 * 10**6))
    ids = {name: i for i, name in enumerate(texts)}
    docs = spark.createDataFrame([(ids[n], t) for n, t in texts.items()], "doc_id long, text string")
    keys = spark.createDataFrame([(ids[n], [bands.get(n, {}).get(b) or next(own) for b in range(nd.BANDS)]) for n in texts], "first_id long, bands array<long>")
    nodes = docs.select(nd._node().alias("node"), nd.F.col("doc_id").alias("first_id")).join(keys, "first_id").select("node", "first_id", "bands")
    idf = nd.idf_table(*nd.document_frequencies(docs))
    names = {bytes(r["node"]): r["first_id"] for r in nodes.collect()}
    found = nd.links(docs, nodes, idf)
    back = {i: n for n, i in ids.items()}
    return {frozenset(back[names[bytes(x)]] for x in (r["leader"], r["node"])) for r in found.collect()} if found else set()


def edited(words, *places):
    return [f"edit{k}" if k in places else w for k, w in enumerate(words)]


def plain(name):
    return " ".join(f"{name}_{k}" for k in range(200))


def test_linked_members_under_a_foreign_hub_are_compared(spark):
    a = [f"w{k}" for k in range(200)]
    b = edited(a, 20, 40, 60)
    texts = {"a": " ".join(a), "b": " ".join(b), "a2": " ".join(edited(a, 100, 120, 140)), "b2": " ".join(edited(b, 160, 170, 180)), "hub": plain("hub")}
    texts |= {f"far{i}": plain(f"far{i}") for i in range(12)}
    bands = {"a": {0: 1, 2: 3}, "a2": {0: 1}, "b": {1: 2, 2: 3}, "b2": {1: 2}, "hub": {2: 3, 3: 4}} | {f"far{i}": {3: 4} for i in range(12)}
    assert crafted(spark, texts, bands) == {frozenset(x) for x in (("a", "a2"), ("b", "b2"), ("a", "b"))}


@pytest.mark.parametrize("block", [512, 3])
def test_pairs_beyond_the_first_leaders_of_a_bucket_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block, raising=False)
    a = [f"w{k}" for k in range(200)]
    texts = {"a": " ".join(a), "b": " ".join(edited(a, 20, 40, 60))} | {f"far{i}": plain(f"far{i}") for i in range(8)} | {f"by{i}": plain(f"by{i}") for i in range(8)}
    bands = {"a": {0: 1}, "b": {0: 1}} | {f"far{i}": {0: 1, 1: 10 + i} for i in range(8)} | {f"by{i}": {1: 10 + i} for i in range(8)}
    assert crafted(spark, texts, bands) == {frozenset(("a", "b"))}
